"""Per-document text quality statistics and published fixed-threshold rules, as Column expressions that stay in the JVM.

Words are taken out of each line once; all counts of a document are sums over its lines. Published rules name what they
find wrong with a document. Whether most of a text is running sentences is decided line by line: a line runs if it
passes the published rules for lines (three words or more, no bullet, common words) and isn't built by delimiters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Common words by language; fixed values, a parameter of every function.
COMMON = {
    "en": (
        "a an and are as at be been but by for from had has have he her his if in is it its near no not of on only or our she so "
        "that the their them then there they this to until was we were when which with would you about because before after again"
    ).split(),
    "de": (
        "aber als am auch auf aus bei beim bis da das dem den der des die du ein eine einem einen einer er es für hat ich ihr im "
        "ist kein keine mit nach nicht noch nur oder schon sich sie sind um und unter vom von vor war wenn wie wird wir zu zum zur"
    ).split(),
    "es": (
        "al ante cada como con cuando de del desde donde el ella en entre esta este está fue hay hasta la las le lo los más mi muy "
        "o para pero por porque que se según ser si sin sobre son su sus también todavía un una unas uno unos y ya"
    ).split(),
}
#: The eight stop words of a published rule, and as many of the commonest words of the other languages; fixed values.
STOP = {
    "en": "the be to of and that have with".split(),
    "de": "der die und in das von zu mit".split(),
    "es": "de la que el en y los con".split(),
}

BULLET = r"^\s*(?:[-*•–·◦‣]|\d{1,3}[.)]|\p{L}\))\s"
#: What a line of a list, table, log or code may begin with.
OPENS = BULLET + r"|^\s*[\[{<]"
QUOTED = r"^\s*[|>]+ "
ENDS = r"[.!?…]['\"”’»)\]]*$"
SENTENCE_END = r"[.!?…](?:(?<=\p{L}\p{L}.)[.!?…]*['\"”’»)\]]*(?:\s|$)|(?<=\d[.!?])[.!?]*['\"”’»)\]]*(?:\s+\p{L}|\s*$))"
BLANKS = " \t  　"

#: What is wrong with a document, by rules published with their thresholds; fixed values.
RULES = {
    # Rae et al. 2021 (Gopher), A1.1
    "word_count": "n_words < 50 or n_words > 100000",
    "word_length": "mean_word_length < 3 or mean_word_length > 10",
    "hashes": "hash_word_ratio > 0.1",
    "ellipses": "ellipsis_word_ratio > 0.1",
    "bullet_lines": "bullet_line_share > 0.9",
    "ellipsis_lines": "ellipsis_line_share > 0.3",
    "alphabetic_words": "alpha_word_share < 0.8",
    "stop_words": "n_stop_words < 2",
    # Raffel et al. 2020 (C4), 2.2
    "sentences": "n_sentences < 5",
    "curly_bracket": "has_curly_bracket",
    # Penedo et al. 2024 (FineWeb), 3.6
    "line_punctuation": "punct_line_share <= 0.12",
    "repeated_lines": "repeated_line_share >= 0.1",
    "short_lines": "short_line_share >= 0.67",
}
#: The rules of this package for what is natural prose; what they look at is counted by the statistics above.
PROSE = {
    "few_running_sentences": "running_share < 0.5",
    "few_common_words": "common_word_share < 0.1",
    "only_common_words": "common_word_share > 0.65",
    "no_sentences": "n_words >= 40 and n_sentences * 80 < n_words",
}


def _share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def _let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.get(F.transform(F.array(value), body), 0)


def _occurrences(x: Column, part: str) -> Column:
    return (F.length(x) - F.length(F.replace(x, F.lit(part), F.lit("")))) / len(part)


def _structured(line: Column) -> Column:
    """An item, log or code by how it begins, a table or menu by its delimiters; all patterns take linear time. A
    semicolon or comma in running text has a blank behind it."""
    bars = _occurrences(line, "|") + _occurrences(line, "›")
    tight = lambda c: _occurrences(line, c) - _occurrences(line, c + " ")
    columns = F.when(line.contains("   "), F.regexp_count(line, F.lit(r"\S {3,}(?=\S)"))).otherwise(0)
    return line.contains("\t") | (bars >= 2) | line.rlike(OPENS) | (tight(";") >= 3) | (tight(",") - F.when(line.endswith(","), 1).otherwise(0) >= 3) | (columns >= 2)


def _line(line: Column, common: list[str], stop: list[str], wanted: set[str]) -> Column:
    marked = F.substring(F.ltrim(line), 1, 1).isin("|", ">")
    words = lambda b: F.regexp_extract_all(F.lower(b), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))

    def of(s: Column) -> Column:
        w, end = s["w"], s["end"]
        ends = F.substring(end, -16, 16).rlike(ENDS)
        # most words begin with one of a to z and need no pattern
        first = F.struct(F.filter(w, lambda x: x.isin(common)).alias("c"), F.size(F.filter(w, lambda x: ((x >= "a") & (x < "{")) | x.rlike(r"\p{L}"))).alias("alpha"), _structured(s["bare"]).alias("structured"))

        def counts(k: Column) -> Column:
            out = {
                "n": F.length(line), "words": F.size(w), "letters": F.length(F.array_join(w, "")), "alpha": k["alpha"], "common": F.size(k["c"]), "stop": F.size(F.filter(k["c"], lambda x: x.isin(stop))),
                "runs": ~k["structured"] & (k["alpha"] >= 3) & (F.size(k["c"]) * 8 >= F.greatest(F.lit(8), k["alpha"])), "closes": ~k["structured"] & ends,
                "punct": ends, "bullet": line.rlike(BULLET), "dots": end.endswith("…") | end.endswith("..."),
            }
            return F.struct(*[c.alias(name) for name, c in out.items() if name in wanted])

        return _let(first, counts)

    return _let(F.when(marked, F.regexp_replace(line, QUOTED, "")).otherwise(line), lambda b: _let(F.struct(words(b).alias("w"), b.alias("bare"), F.rtrim(line, F.lit(BLANKS)).alias("end")), of))


def _total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0).cast("long"), lambda acc, v: acc + v)


#: What each statistic needs to know of the lines.
NEEDS = {
    "n_chars": "", "n_words": "words", "mean_word_length": "letters words", "symbol_ratio": "letters", "hash_word_ratio": "words", "ellipsis_word_ratio": "words", "alpha_word_share": "alpha words",
    "n_lines": "", "punct_line_share": "punct", "bullet_line_share": "bullet", "ellipsis_line_share": "dots", "short_line_share": "", "repeated_line_share": "", "common_word_share": "common words",
    "n_stop_words": "stop", "n_sentences": "", "has_curly_bracket": "", "running_share": "runs closes",
}


def _statistics(x: Column, common: list[str], stop: list[str], statistics: list[str]) -> Column:
    wanted = {"n", *" ".join(NEEDS[s] for s in statistics).split()}

    def of(p: Column) -> Column:
        f, lines = p["f"], p["lines"]
        n_lines = F.size(f)
        total = lambda name: _total(F.transform(f, lambda s: s[name]))
        count = lambda name: F.size(F.filter(f, lambda s: s[name]))
        sums = [total(name).alias(name) for name in ("n", "words", "letters", "alpha", "common", "stop") if name in wanted]
        solid = F.length(F.translate(x, BLANKS + "\r\n\f\v", ""))

        def out(t: Column) -> Column:
            running = lambda s, i: F.when(s["runs"] | (s["closes"] & (i > 0) & F.coalesce(F.get(f, i - 1)["runs"], F.lit(False))), s["n"]).otherwise(0)
            every = {
                "n_chars": lambda: F.length(x).cast("long"), "n_words": lambda: t["words"], "mean_word_length": lambda: _share(t["letters"], t["words"]),
                "symbol_ratio": lambda: _share(solid - t["letters"], solid), "hash_word_ratio": lambda: _share(_occurrences(x, "#"), t["words"]),
                "ellipsis_word_ratio": lambda: _share(_occurrences(x, "...") + _occurrences(x, "…"), t["words"]), "alpha_word_share": lambda: _share(t["alpha"], t["words"]),
                "n_lines": lambda: n_lines.cast("long"), "punct_line_share": lambda: _share(count("punct"), n_lines), "bullet_line_share": lambda: _share(count("bullet"), n_lines),
                "ellipsis_line_share": lambda: _share(count("dots"), n_lines), "short_line_share": lambda: _share(F.size(F.filter(f, lambda s: s["n"] < 30)), n_lines),
                "repeated_line_share": lambda: _share(t["n"] - _total(F.transform(F.array_distinct(lines), F.length)), t["n"]), "common_word_share": lambda: _share(t["common"], t["words"]),
                "n_stop_words": lambda: t["stop"], "n_sentences": lambda: F.regexp_count(x, F.lit(SENTENCE_END)).cast("long"), "has_curly_bracket": lambda: x.contains("{"),
                "running_share": lambda: _share(_total(F.transform(f, running)), t["n"]),
            }
            return F.struct(*[every[s]().alias(s) for s in statistics])

        return _let(F.struct(*sums), out)

    lines = F.filter(F.split(F.translate(x, "\r", "\n"), "\n", -1), lambda s: F.trim(s) != "")
    return _let(lines, lambda ls: _let(F.struct(F.transform(ls, lambda s: _line(s, common, stop, wanted)).alias("f"), ls.alias("lines")), of))


def _measured(documents: DataFrame, doc_id: str, text: str, common: dict, stop: dict, statistics: list[str]) -> DataFrame:
    flat = lambda d: sorted({w for ws in d.values() for w in ws})
    rows = documents.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("x"))
    # a generator, so that no later filter or selection makes Catalyst copy the expressions
    return rows.select("doc_id", F.inline(F.transform(F.array("x"), lambda x: _statistics(x, flat(common), flat(stop), statistics))))


def _failing(rules: dict[str, str]) -> Column:
    return F.concat_ws(",", F.array_compact(F.array(*[F.when(F.expr(rule), F.lit(name)) for name, rule in rules.items()])))


def natural_prose(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", common: dict[str, list[str]] = COMMON) -> DataFrame:
    """(doc_id, prose_reasons, natural) as quality() has them, with only the statistics that these rules need."""
    stats = _measured(documents, doc_id, text, common, {}, ["n_words", "common_word_share", "n_sentences", "running_share"])
    return stats.select("doc_id", _failing(PROSE).alias("prose_reasons")).withColumn("natural", F.col("prose_reasons") == "")


def quality(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", common: dict[str, list[str]] = COMMON, stop: dict[str, list[str]] = STOP) -> DataFrame:
    """(doc_id, n_chars, n_words, mean_word_length, symbol_ratio, hash_word_ratio, ellipsis_word_ratio,
    alpha_word_share, n_lines, punct_line_share, bullet_line_share, ellipsis_line_share, short_line_share,
    repeated_line_share, common_word_share, n_stop_words, n_sentences, has_curly_bracket, running_share, reasons,
    prose_reasons, natural), one row for each row with an id.

    A word is a run of letters and digits. running_share: characters of lines of running sentences, by characters of
    all lines. A line runs if it isn't an item, table row, log, code or menu and holds common words among three words
    or more (a mark of quotation before it is left out of account), or ends the sentence of such a line. Texts may mix
    languages, so the words of all languages given count. reasons names each published rule that fails, prose_reasons
    each rule of PROSE, in their order, joined by commas; natural: none of PROSE fails. A null text counts as an empty
    one: all statistics are 0 and it isn't natural prose. No rows give no rows. Other columns are ignored.
    """
    stats = _measured(documents, doc_id, text, common, stop, list(NEEDS))
    return stats.withColumns({"reasons": _failing(RULES), "prose_reasons": _failing(PROSE)}).withColumn("natural", F.col("prose_reasons") == "")
