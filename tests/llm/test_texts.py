import random
import re

import numpy as np
import pytest

from wayline.llm import leaks as lk
from wayline.llm import mixing
from wayline.llm.mixing import mix, pfair, rounds, schedule, token_counts
from wayline.llm.quality import natural_prose, quality

WORDS = [f"w{i}" for i in range(400)]


def passage(seed, n=60):
    return [random.Random(seed).choice(WORDS) + str(random.Random(seed * 1000 + i).randrange(50)) for i in range(n)]


def hold(text, pas):
    """The rule itself, by dynamic programming over all stretches."""
    n, best, prev = len(text), 0, [0] * (len(text) + 1)
    for w in pas:
        cur = [0] + [prev[j] + 1 if text[j] == w else 0 for j in range(n)]
        best, prev = max(best, *cur), cur
    if best >= 12:
        return True
    for s in range(len(pas) - 29):
        row = [0] * (n + 1)
        for size, w in enumerate(pas[s : s + 60], 1):
            new = [row[0] + 1]
            for j in range(n):
                new.append(min(row[j] + (text[j] != w), row[j + 1] + 1, new[j] + 1))
            row = new
            if size >= 30 and min(row) * 6 <= size:
                return True
    return False


def test_leaks_against_the_rule():
    rng = random.Random(11)
    seen = {True: 0, False: 0}
    for _ in range(60):
        pas = [rng.randrange(40) for _ in range(rng.choice([28, 40, 65]))]
        size = rng.choice([11, 12, 29, 30, 36])
        s = rng.randrange(max(1, len(pas) - size))
        part = pas[s : s + size]
        for _ in range(rng.choice([0, 3, 5, 6, 7])):
            k, p = rng.random(), rng.randrange(len(part))
            if k < 0.6:
                part[p] = rng.randrange(1000, 2000)
            elif k < 0.8:
                part.insert(p, rng.randrange(1000, 2000))
            elif len(part) > 1:
                del part[p]
        text = [rng.randrange(40) for _ in range(15)] + part + [rng.randrange(40) for _ in range(15)]
        a, b = (lk.word_hashes([" ".join(map(str, ws))])[0] for ws in (text, pas))
        at = {}
        for q, g in enumerate(lk.grams(b, lk.K)):
            at.setdefault(int(g), []).append(q)
        hits = [(x, q) for x, g in enumerate(lk.grams(a, lk.K)) for q in at.get(int(g), ())]
        want = hold(text, pas)
        seen[want] += 1
        assert bool(lk.match(a.tolist(), set(a.tolist()), b.tolist(), hits)) == want
    assert min(seen.values()) > 5


def test_leaks_in_tables(spark):
    p, q = passage(1), passage(2)
    docs = [
        (1, "before " + " ".join(p[5:17]).upper() + " after"), (2, " ".join(p[5:16])), (3, "\n\n".join(", ".join(q[i : i + 7]) for i in range(0, 60, 7))), (4, None), (5, ""), (None, " ".join(p)),
        (6, "x " * 200_000 + " ".join(q[:12]) + " y" * 1000), (1, "before " + " ".join(p[5:17]).upper() + " after"), (7, " ".join(p) + " " + " ".join(q)),
    ]
    d = spark.createDataFrame([(*x, "clash") for x in docs], "doc_id long, text string, item_id string")
    items = spark.createDataFrame([(10, " ".join(p)), (20, " ".join(q)), (30, "too short"), (40, None), (None, " ".join(p)), (10, " ".join(p))], "item_id long, passage string")
    want = {(1, 10), (3, 20), (6, 20), (7, 10), (7, 20)}
    got = [(r.doc_id, r.item_id) for r in lk.leaks(d, items).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert lk.leaks(d.limit(0), items).count() == 0 and lk.leaks(d, items.limit(0)).count() == 0


def test_words_are_hashed_alike_in_any_piece(monkeypatch):
    texts = ["Ein Straßen-Schild, größer als 3²m!", "", "  ", "x" * 70 + " tail", "ÉTÉ_été 12th", "\ud800 odd", "İstanbul"]
    whole, first = lk.word_hashes(texts)
    assert np.diff(first).tolist() == [6, 0, 0, 2, 3, 1, len(re.findall(r"[^\W_]+", "İstanbul".lower()))]
    assert whole[first[4]] == whole[first[4] + 1] and len(set(whole.tolist())) == len(whole) - 1
    monkeypatch.setattr(lk, "PIECE_CHARS", 5)
    assert (lk.word_hashes(texts)[0] == whole).all()
    for t, a, b in zip(texts, first, first[1:]):
        assert (lk.word_hashes([t])[0] == whole[a:b]).all()


def leaked(spark, docs, items):
    d = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    i = spark.createDataFrame(list(enumerate(items)), "item_id long, passage string")
    return {(r.doc_id, r.item_id): (r.kind, r.n_words) for r in lk.leaks(d, i).collect()}


def test_the_whole_extent_of_a_long_edited_passage(spark):
    p = passage(5, 400)
    edited = ["other" if i % 11 == 10 else w for i, w in enumerate(p)]
    (kind, n), = leaked(spark, ["start " + " ".join(edited) + " end"], [" ".join(p)]).values()
    assert kind == "edited" and n > 390


def test_stock_phrases_are_no_fingerprints_and_nothing_is_lost(spark, monkeypatch):
    monkeypatch.setattr(lk, "HOT", 3)
    stock = "please read the following note with care before use".split()
    items = [stock + passage(100 + i, 45) for i in range(8)] + [stock * 4 + passage(200, 5)] * 5 + [stock * 4 + passage(201 + i, 2) for i in range(5)]
    items += [passage(300, 6) + stock + passage(301, 3)] * 2
    rng = random.Random(5)

    def edit(ws, every):
        return [rng.choice(["zz", "qq"]) if i % every == every - 1 else w for i, w in enumerate(ws)]

    docs = [stock, items[0][3:], edit(items[1], 6), edit(items[2][:30], 6), items[3][4:15], items[4][3:15], stock * 2, edit(stock * 4, 7), stock * 4, items[-1], passage(9, 80), edit(items[5], 5), stock + passage(9, 30)]
    rows = [(i, lk.word_hashes([" ".join(x)])[0].tobytes()) for i, x in enumerate(items[:8])]
    index, _ = lk.fingerprints(spark.createDataFrame(rows, "key long, words binary"))
    shared = {int(np.int64(g)) for g in lk.grams(lk.word_hashes([" ".join(stock)])[0], lk.K).view(np.int64)}
    assert not shared & {r.hash for r in index.collect()}
    got = set(leaked(spark, [" ".join(x) for x in docs], [" ".join(x) for x in items]))
    assert got == {(d, i) for d, x in enumerate(docs) for i, p in enumerate(items) if hold(x, p)}
    assert len(got) > 20


@pytest.mark.parametrize("blocks", [{"a": 5, "b": 3, "c": 2}, {"a": 1, "b": 97, "c": 31, "d": 7}, {"a": 4}, {"a": 0, "b": 2}])
def test_pfair_stays_within_a_block(blocks):
    out = list(pfair(blocks))
    total, done = sum(blocks.values()), dict.fromkeys(blocks, 0)
    for slot, s, k in out:
        assert k == done[s]
        done[s] += 1
        for x in blocks:
            assert abs(done[x] - blocks[x] * (slot + 1) / total) < 1
    assert done == blocks and [x[0] for x in out] == list(range(total))


@pytest.mark.parametrize("blocks,n", [([5, 3, 2], 2), ([1000, 970, 31, 7, 1], 40), ([999, 1], 100), ([64, 64, 64, 64, 1], 50), ([7, 900, 0, 93], 30), ([1] * 90, 9)])
def test_rounds_stay_within_a_block(blocks, n):
    total, done, t = sum(blocks), [0] * len(blocks), 0
    size = -(-total // n)
    for e, counts in enumerate(rounds(blocks, n), 1):
        done, t = [a + b for a, b in zip(done, counts)], t + sum(counts)
        assert size - 1 <= sum(counts) <= size
        assert all(abs(a - b * e / n) < 1 for a, b in zip(done, blocks))
    assert done == blocks and t == total


def test_rounds_for_random_weights():
    rng = random.Random(8)
    for _ in range(60):
        blocks = [int(rng.expovariate(1) ** 2 * 50) for _ in range(rng.randrange(1, 12))]
        n = rng.randrange(1, 60)
        done = [0] * len(blocks)
        for e, counts in enumerate(rounds(blocks, n) if sum(blocks) else [], 1):
            done = [a + b for a, b in zip(done, counts)]
            assert all(abs(a - b * e / n) < 1 for a, b in zip(done, blocks))
        assert done == blocks


def test_a_schedule_of_rounds_deviates_by_less_than_two_of_its_blocks(spark, monkeypatch):
    monkeypatch.setattr(mixing, "ROUND_SLOTS", 50)
    blocks = {"a": 700, "b": 211, "c": 80, "d": 9}
    rows = sorted(tuple(r) for r in schedule(spark, blocks).collect())
    assert [r[0] for r in rows] == list(range(1000))
    done = dict.fromkeys(blocks, 0)
    for slot, s, k in rows:
        assert k == done[s]
        done[s] += 1
        assert all(abs(done[x] - blocks[x] * (slot + 1) / 1000) < 2 for x in blocks)


def test_every_target_counts(spark):
    n = 10_001
    d = spark.range(n).selectExpr("id as doc_id", "'a few words' as text", "concat('s', id) as source")
    t = spark.range(n).selectExpr("concat('S', id) as source", f"1D / {n} as target_share", "1 as max_repeats")
    draws, shares = mix(d, t)
    assert draws.count() == n and shares.where("n_draws = 1").count() == n


def test_mix(spark):
    rng = random.Random(2)
    docs = [(i, " ".join(rng.choices(WORDS, k=rng.randrange(5, 60))), ["big", " BIG\t", "small", "other"][min(i % 5, 3)]) for i in range(500)] + [(900, None, "small"), (None, "x", "big"), (901, "", "small"), (902, "x", None)]
    d = spark.createDataFrame([(*x, 1) for x in docs + docs[:7]], "doc_id long, text string, source string, block int")
    t = spark.createDataFrame([("Big", 0.5, 1), ("small", 0.5, 3), ("absent", 0.0, 1)], "source string, target_share double, max_repeats int")
    draws, shares = mix(d, t, block_tokens=400)
    s = {r.source: r for r in shares.collect()}
    assert set(s) == {"Big", "small", "absent"} and s["absent"].n_tokens == 0
    assert abs(s["Big"].actual_share - 0.5) < 0.02 and s["small"].most_copies <= 3
    rows = draws.collect()
    assert len(rows) == len({(r.doc_id, r.copy) for r in rows}) and len({r.slot for r in rows}) == max(r.slot for r in rows) + 1
    assert {r.source for r in rows} == {"Big", "small"} and all(r.doc_id < 500 or r.doc_id in (900, 901) for r in rows)
    assert mix(d, t, block_tokens=400)[0].exceptAll(draws).count() == 0
    short = {r.source: r for r in mix(d, t, total_tokens=10**7)[1].collect()}
    assert short["small"].limited and short["Big"].limited and short["small"].most_copies == 3
    assert mix(d.limit(0), t)[0].count() == 0 and mix(d, t.limit(0))[0].count() == 0


def test_tokens(spark):
    df = spark.createDataFrame([("hello world",), (None,), ("",), ("<|endoftext|>",)], "text string")
    n = [r.n_tokens for r in token_counts(df, "text").collect()]
    assert n[0] == 2 and n[1:3] == [0, 0] and n[3] > 1


PROSE = "The surface near the old bridge was checked again on Tuesday, and nothing was found. It is not clear whether the team looked at the same place."
TABLE = "\n".join(f"S{i:04d} | D40 | {i} | 12.5" for i in range(30))
LIST = "\n".join(f"- Quay {i}, ruts" for i in range(30))
SOUP = "lorry " * 120


def test_quality(spark):
    texts = [PROSE, TABLE, LIST, SOUP, PROSE + "\n\n" + TABLE, PROSE.replace(" ", "\n", 0) + " " + PROSE + "\n" + LIST[:120], "", None, "\n".join(PROSE[i : i + 40] for i in range(0, len(PROSE), 40)), "x" * 300_000, PROSE * 3000]
    df = spark.createDataFrame([(i, x, "clash") for i, x in enumerate(texts)] + [(None, PROSE, "")], "doc_id long, text string, lines string")
    r = {x.doc_id: x for x in quality(df).collect()}
    assert [i for i in sorted(r) if r[i].natural] == [0, 5, 8, 10]
    assert r[0].n_words == len(PROSE.split()) and abs(r[0].punct_line_share - 1) < 1e-9 and r[0].running_share == 1
    assert "few_running_sentences" in r[4].prose_reasons and r[2].bullet_line_share == 1 and "bullet_lines" in r[2].reasons
    assert r[6].n_chars == r[7].n_chars == 0 and r[6].reasons == r[7].reasons and r[1].symbol_ratio > 0.15
    assert {x.doc_id: (x.prose_reasons, x.natural) for x in natural_prose(df).collect()} == {i: (x.prose_reasons, x.natural) for i, x in r.items()}
    assert quality(df.limit(0)).count() == 0


def test_published_rules_at_their_thresholds(spark):
    words = "the road and its edge have been seen with care".split()
    prose = lambda n: " ".join(words[i % 10] for i in range(n))
    sentences = "The road is dry and was checked with care on Monday. " * 6
    cases = {
        "word_count": (prose(49), prose(50)), "word_length": ("ab " * 60, "abc " * 60), "hashes": ("#word " * 60, prose(60)), "ellipses": ("and so ... " * 30, prose(60)),
        "bullet_lines": ("\n".join(["- one more"] * 19 + ["end."]), "\n".join(["- one more"] * 9 + ["end."])), "ellipsis_lines": ("and so...\n" * 4 + "end.\n" * 6, "and so...\n" * 3 + "end.\n" * 7),
        "alphabetic_words": ("12 word 7 " * 20, "word 12 word word word " * 20), "stop_words": ("lorry " * 60, "lorry the and " * 20), "sentences": ("The road is dry. " * 4, sentences),
        "curly_bracket": ("if (a) { b }", sentences), "line_punctuation": ("\n".join(["no end"] * 9 + ["end."]), "\n".join(["no end"] * 7 + ["end."])),
        "repeated_lines": (sentences + "\n" + sentences, sentences), "short_lines": ("short\n" * 67 + (prose(12) + "\n") * 33, "short\n" * 66 + (prose(12) + "\n") * 34),
    }
    rows = [(f"{name}{k}", text) for name, both in cases.items() for k, text in enumerate(both)]
    got = {r.doc_id: r.reasons.split(",") for r in quality(spark.createDataFrame(rows, "doc_id string, text string")).collect()}
    for name in cases:
        assert name in got[f"{name}0"] and name not in got[f"{name}1"], name
