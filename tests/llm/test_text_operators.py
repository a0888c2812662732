"""Each operator against a brute-force version, and on odd input."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from conftest_llm import ODD
from pyspark.sql import functions as F

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def corpus(seed=3, n=90):
    """Prose with exact and near copies, and passages that many texts share."""
    rng = random.Random(seed)
    vocab = [f"{a}{b}" for a in "bcdfghklmnprst" for b in ("ar", "eno", "il", "osk", "um")]
    passage = [rng.choice(vocab) for _ in range(70)]
    rows, texts = [], []
    for i in range(n):
        kind = rng.random()
        if texts and kind < 0.15:
            t = rng.choice(texts)
        elif texts and kind < 0.45:
            w = rng.choice(texts).split(" ")
            for _ in range(max(1, len(w) // rng.choice((9, 25, 60)))):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            t = " ".join(w)
        else:
            w = [rng.choice(vocab) for _ in range(rng.choice((3, 6, 30, 120, 260)))]
            if rng.random() < 0.5:
                at = rng.randrange(len(w))
                lo = rng.randrange(15)
                w[at:at] = passage[lo:lo + rng.choice((50, 55))]
            t = " ".join(w)
        texts.append(t)
        rows.append((i * 7 % 1000, t, "en", f"s{i % 4}"))
    return rows


# -- n-gram Jaccard join ---------------------------------------------------------------

def brute_components(rows):
    sets = {}
    for i, t in rows:
        w = WORD.findall((t or "").translate(LOWER))
        sets[i] = {tuple(w[k:k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    up = {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i
    ids = sorted(sets)
    for x, i in enumerate(ids):
        for j in ids[:x]:
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * len(sets[i] | sets[j]):
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), root(i)) for i in ids}


@pytest.mark.parametrize("tile_rows,common", [(2000, 8), (4, 1), (4, 3)])
def test_jaccard_components_equal_brute_force(frame, tile_rows, common):
    """With tiles of four rows every tile is cut: blocks, delegates and crossings all run;
    with one document in eight enough to make a hash common, prefixes come from the texts."""
    from loadstats.llm.jaccard_join import jaccard_components
    rows = corpus()
    got = {r[0]: (r[1], r[2]) for r in jaccard_components(frame(rows), tile_rows=tile_rows, common=common).collect()}
    want = brute_components([r[:2] for r in rows])
    assert got == want and sum(r != i for i, (_, r) in want.items()) > 15


def test_jaccard_odd_rows(frame):
    from loadstats.llm.jaccard_join import jaccard_components, one_of_each
    got = sorted(map(tuple, jaccard_components(frame(ODD)).collect()), key=str)
    by = {r[0]: r[1:] for r in got}
    assert len(got) == len(ODD) and by[None] == (2, None)
    assert by[1] == (0, 1) and by[2] == (0, 2) and by[3] == (0, 3) and by[4] == (1, 4)
    assert by[5] == (2, 5) and by[6] == (2, 5) and by[9] == (1, 9)
    left = [r["doc_id"] for r in one_of_each(frame(ODD)).collect()]
    assert sorted(left, key=str) == sorted([None, 1, 2, 3, 4, 5, 7, 8, 9], key=str)
    assert jaccard_components(frame([])).count() == 0


def test_jaccard_repeated_id_with_different_texts(frame):
    """An id with two texts is one node: what is like either belongs to it."""
    from loadstats.llm.jaccard_join import jaccard_components
    a, b = "one two three four five six seven", "red green blue white black brown grey"
    got = {(r[0], r[2]) for r in jaccard_components(frame([(5, a), (5, b), (3, a), (9, b), (7, "else " * 9)])).collect()}
    assert got == {(3, 3), (5, 3), (9, 3), (7, 7)}


# -- substring dedup -------------------------------------------------------------------

def brute_removed(rows, words=50):
    out, seen = {}, {}
    for i, t in sorted(rows):
        w = WORD.findall(t or "")
        gone = [False] * len(w)
        spans = [tuple(w[p:p + words]) for p in range(len(w) - words + 1)]
        for p, s in enumerate(spans):
            if s in seen:
                gone[p:p + words] = [True] * words
        for s in spans:
            seen.setdefault(s, i)
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out[i] = (len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


@pytest.mark.parametrize("words,k", [(50, 16), (8, 3)])
def test_substring_dedup_equals_brute_force(frame, words, k):
    from loadstats.llm.substring_dedup import remove_spans, repeated_spans
    docs = frame(corpus(5))
    got = remove_spans(docs, repeated_spans(docs, words=words, k=k), words=words).collect()
    want = brute_removed([r[:2] for r in corpus(5)], words)
    assert {r[0]: (r[1], r[2], r[3]) for r in got} == want and sum(v[1] > 0 for v in want.values()) > 10


def test_substring_branches_and_loops(frame):
    """Texts that go round a loop, and texts that part and meet again."""
    from loadstats.llm.substring_dedup import remove_spans, repeated_spans
    rng = random.Random(8)
    base = [f"b{i}" for i in range(40)]
    rows = []
    for i in range(40):
        w = []
        while len(w) < 60:
            at = rng.randrange(35)
            w += base[at:at + rng.randrange(2, 14)]
        rows.append((i, " ".join(w * rng.choice((1, 2)))))
    docs = frame(rows)
    got = {r[0]: (r[1], r[2], r[3]) for r in remove_spans(docs, repeated_spans(docs, words=6, k=2), words=6).collect()}
    assert got == brute_removed(rows, 6)


def test_substring_odd_rows(frame):
    from loadstats.llm.substring_dedup import remove_spans, repeated_spans, without_spans
    long = " ".join(f"w{i}" for i in range(80))
    rows = [*ODD, (None, long), (20, long), (20, long), (21, "x\n\n" + long + "  y")]
    docs = frame(rows)
    spans = repeated_spans(docs)
    got = remove_spans(docs, spans).collect()
    assert len(got) == len(rows)
    lost = {(r["doc_id"], r["n_words"], r["n_removed"]) for r in got if r["n_removed"]}
    assert lost == {(21, 82, 80)}
    out = without_spans(docs, spans)
    assert out.columns == docs.columns
    texts = sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=str)
    assert texts == sorted([(i, "x y" if i == 21 else t) for i, t in rows], key=str)
    assert repeated_spans(frame([])).count() == 0


# -- language ID -----------------------------------------------------------------------

TONGUES = {"en": "the of and to in that was his with for had you not are but her from they which".split(),
           "de": "der die und das nicht von sie ist des sich mit dem dass auf eine für wird über".split(),
           "es": "que los del las por una con para está como más pero sus muy sobre también niño".split()}


def prose(lang, n, seed):
    rng = random.Random(f"{lang}{seed}")
    return " ".join(rng.choice(TONGUES[lang]) for _ in range(n))


def test_language_profiles_on_held_out_texts(frame):
    from loadstats.llm.language_id import language_digest
    rows = [(i, prose(lang, 60, i), lang, "s") for i, lang in enumerate(list(TONGUES) * 30)]
    got = language_digest(frame(rows)).collect()
    want = {r[0]: r[2] for r in rows}
    held = [r for r in got if r["held_out"]]
    assert len(got) == 90 and 15 < len(held) < 45
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got)
    assert all(r["lang_pred"] == want[r["doc_id"]] and 0 <= r["score"] <= 1 for r in got)


def test_language_predictions_equal_brute_force():
    from collections import Counter

    from loadstats.llm.language_id import Profiles, ngrams, ranked
    def count(t):
        words = re.findall(r"[^\W\d_]+", t.lower())
        return Counter(x for w in words for n in (1, 2, 3) for s in ["\1" + w + "\1"]
                       for x in (s[i:i + n] for i in range(len(s) - n + 1))
                       if x != "\1" and not (n == 3 and x[1] == "\1"))
    code = lambda x: sum(ord(c) << (21 * i) for i, c in enumerate(x))
    learned = {k: " ".join(prose(k, 200, 1) for _ in range(1)) for k in TONGUES}
    p = Profiles({k: ranked(*ngrams(t), 300) for k, t in learned.items()})
    best = {k: [g for g, _ in sorted(count(t).items(), key=lambda x: (-x[1], code(x[0])))][:300] for k, t in learned.items()}
    for k in TONGUES:
        for text in (prose(k, 5, 9), prose(k, 80, 9) + " 12, DER Niño!\nx", "Zz"):
            own = [g for g, _ in sorted(count(text).items(), key=lambda x: (-x[1], code(x[0])))][:300]
            far = {n: sum(min(300, abs(i - b.index(g))) if g in b else 300 for i, g in enumerate(own)) for n, b in best.items()}
            want = min(sorted(far), key=far.get)
            got = p.predict(text)
            assert got[0] == want and got[1] == pytest.approx(1 - far[want] / (300 * len(own)))


def test_language_odd_rows(frame):
    from loadstats.llm.language_id import identify, language_digest, learn_profiles
    rows = [(i, prose("en", 40, i), "en", "s") for i in range(12)] + [(r[0], r[1], None, None) for r in ODD]
    got = language_digest(frame(rows)).collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: r for r in got if (r["doc_id"] or 0) < 10}
    none = [r for r in got if r["lang_pred"] == "und"]
    assert len(none) >= 4 and all(r["score"] == 0 for r in none) and by[None]["held_out"] is False
    assert identify(frame(rows), learn_profiles(frame([]))).where("lang_pred != 'und'").count() == 0
    assert language_digest(frame([])).count() == 0


# -- quality rules ---------------------------------------------------------------------

def test_quality_rules_equal_brute_force(spark, frame):
    import xxhash

    from loadstats.llm.quality_rules import quality_rules
    rng = random.Random(4)
    rows = [*((i, t) for i, t, *_ in corpus(6, 30)),
            (900, "one two three four five six seven eight " * 4), (901, "A #b $\n\nline\nline\n \n \nline x"),
            (902, "x " * 40), (903, " ".join(rng.choice("ab") for _ in range(60))), *ODD]
    trusted = spark.createDataFrame([(0,), (7,), (7,), (14,), (None,)], "doc_id long")
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    one = lambda w: xxhash.xxh64_intdigest(w.encode(), 42)
    pair = lambda a, b: xxhash.xxh64_intdigest(b.to_bytes(8, "little"), xxhash.xxh64_intdigest(a.to_bytes(8, "little"), 42))
    size = 1 << 14

    def bins(t):
        h = [one(w) for w in WORD.findall(t or "")]
        return [signed(v) % size for v in h + [pair(a, b) for a, b in zip(h, h[1:])]]
    raw, good = np.ones(size), np.ones(size)
    for i, t in rows:
        for b in bins(t):
            raw[b] += 1
            good[b] += i in (0, 7, 14)
    weight = np.log(good / good.sum()) - np.log(raw / raw.sum())
    want = []
    for i, t in rows:
        w, lines, seen, dup = WORD.findall(t or ""), (t or "").split("\n"), set(), 0
        for x in lines:
            if WORD.search(x):
                dup += x in seen
                seen.add(x)
        wins = [tuple(w[k:k + 8]) for k in range(len(w) - 7)]
        rep = {p for k, x in enumerate(wins) if wins.count(x) > 1 for p in range(k, k + 8)} if len(w) < 2000 else None
        b = bins(t)
        llr = sum(weight[x] for x in b) / len(b) if b else 0.0
        failed = len(w) < 20 or (rep is not None and 100 * len(rep) > 30 * len(w))
        want.append((i, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), dup,
                     None if rep is None else len(rep), failed, round(llr, 6), not failed and llr >= -0.12))
    got = [(r[0], *r[1:7], round(r["llr"], 6), r["kept"]) for r in quality_rules(frame(rows), trusted).collect()]
    hide = lambda r: r[:5] + ((0, r[6], r[7], 0) if r[1] > 2000 else r[5:])
    assert sorted(map(hide, got), key=str) == sorted((hide(w) for w in want), key=str)
    assert quality_rules(frame([]), trusted).count() == 0
    assert quality_rules(frame(ODD), trusted.limit(0)).where("llr != 0").count() == 0


def test_counted_rules_equal_brute_force(spark, frame):
    from collections import Counter

    import xxhash

    from loadstats.llm.quality_rules import PRIOR, quality_rules, quality_rules_counted
    rows = [*((i, t) for i, t, *_ in corpus(6, 30)), (902, "x " * 40), *ODD]
    trusted = spark.createDataFrame([(0,), (7,), (7,), (14,), (None,)], "doc_id long")

    def grams(t):
        w = WORD.findall(t or "")
        return w + list(zip(w, w[1:]))
    def half(t):
        h = xxhash.xxh64_intdigest((5).to_bytes(4, "little"), xxhash.xxh64_intdigest(t.encode(), 42) if t is not None else 42)
        return (h - (1 << 64) if h >> 63 else h) % 2
    raw, good = [Counter(), Counter()], [Counter(), Counter()]
    for i, t in rows:
        raw[half(t)].update(grams(t))
        good[half(t)].update(grams(t) if i in (0, 7, 14) else ())
    share = [good[f].total() / raw[f].total() for f in (0, 1)]

    def score(t):
        o = 1 - half(t)
        total = sum(np.log((good[o][g] + PRIOR) / (raw[o][g] * share[o] + PRIOR)) for g in grams(t))
        return round(total / max(1, len(grams(t))), 6)
    assert 0 < sum(half(t) for _, t in rows) < len(rows)
    want = [(i, score(t)) for i, t in rows]
    for few in (4, 1 << 12):    # nearly all by the join, or nearly all beside the text
        got = quality_rules_counted(frame(rows), trusted, common_grams=few)
        assert sorted(((r[0], round(r["llr"], 6)) for r in got.collect()), key=str) == sorted(want, key=str)
    base = [sorted((tuple(r)[:7] for r in df.collect()), key=str) for df in (got, quality_rules(frame(rows), trusted))]
    assert base[0] == base[1]
    assert quality_rules_counted(frame([]), trusted).count() == 0
    assert quality_rules_counted(frame([(1, None), (2, " ")]), trusted).where("llr = 0").count() == 2
    assert quality_rules_counted(frame(ODD), trusted.limit(0)).where("llr != 0").count() == 0


def test_counted_rules_reject_junk_of_many_words(spark, frame):
    from loadstats.llm.quality_rules import quality_rules_counted
    rng = random.Random(5)

    def text(words, junk):
        return " ".join("".join(rng.choice("abcdefghijkl") for _ in range(4)) + (rng.choice(("$$$", "&&&", "###")) if junk else "")
                        if rng.random() < 0.6 else rng.choice(words) + ("%%%" if junk else "") for _ in range(100))
    words = [f"w{k}" for k in range(30)]
    rows = [(i, text(words, i % 10 == 3)) for i in range(1500)]     # more n-grams than the former bins
    trusted = spark.createDataFrame([(i,) for i in range(1500) if i % 10 in (0, 1, 2, 4)], "doc_id long")
    wrong = [r["doc_id"] for r in quality_rules_counted(frame(rows), trusted).collect() if r["kept"] == (r["doc_id"] % 10 == 3)]
    assert not wrong


def test_a_label_has_no_part_in_its_own_verdict(spark, frame):
    """Whichever text is marked, its own score stays the same to the last digit."""
    from loadstats.llm.quality_rules import quality_rules_counted
    rng = random.Random(6)
    rows = [(i, " ".join(rng.choice("abcdefgh") + rng.choice("xyz") + ("$$" if i % 5 == 0 else "") for _ in range(60)))
            for i in range(80)]
    rows += [(100, rows[5][1]), (101, rows[5][1])]                      # copies of a text share its half
    good = [i for i in range(80) if i % 5 and i % 2]
    score = lambda ids: {r.doc_id: r.llr for r in quality_rules_counted(
        frame(rows), spark.createDataFrame([(i,) for i in ids], "doc_id long")).collect()}
    plain = score(good)
    for i in (5, 10, 7, 33):
        other = score([*good, i] if i not in good else [g for g in good if g != i])
        assert other[i] == plain[i]
    assert plain != score([*good, 5]) and plain[100] == plain[101] == plain[5]


# -- mixing ----------------------------------------------------------------------------

def test_mixing_targets_and_takes(frame):
    from loadstats.llm.common import n_words
    from loadstats.llm.mixing import mix, mixed
    rng = random.Random(2)
    rows = [(i, " ".join(["w"] * rng.randrange(0, 40)), "en", rng.choice(["a", "b", "b", "b", "b", "c", None])) for i in range(400)]
    out = mix(frame(rows), n_words(F.col("text"))).collect()
    size = {s: sum(len((r[1] or "").split()) for r in rows if r[3] == s) for s in ("a", "b", "c", None)}
    # water-filling by repeated resharing
    weight, left, target = {"a": 5, "b": 2, "c": 1, None: 5}, {"a", "b", "c", None}, {}
    budget = sum(size.values()) * 3 // 2
    while left:
        share = {s: (budget - sum(target.values())) * weight[s] / sum(weight[x] for x in left) for s in left}
        full = {s for s in left if share[s] >= 2 * size[s]}
        if not full:
            target |= share
            break
        target |= {s: 2.0 * size[s] for s in full}
        left -= full
    for s in size:
        own = [r for r in out if r["source"] == s]
        assert all(r["source_size"] == size[s] and r["target"] == pytest.approx(target[s]) for r in own)
        assert abs(sum(r["taken"] for r in own) - target[s]) <= 40
    assert all(r["taken"] <= 2 * r["size"] for r in out) and budget - 40 < sum(r["taken"] for r in out) <= budget
    again = mix(frame(rows).repartition(7), n_words(F.col("text"))).collect()
    assert sorted(map(str, out)) == sorted(map(str, again))
    copies = {r["doc_id"]: r["copies"] for r in out}
    rows_out = mixed(frame(rows), n_words(F.col("text"))).groupBy("doc_id").count().collect()
    assert {r[0]: r[1] for r in rows_out} == {i: n for i, n in copies.items() if n}


def test_mixing_odd_rows(frame):
    from loadstats.llm.common import n_words
    from loadstats.llm.mixing import mix, mixed
    rows = [(r[0], r[1], "en", None if r[0] == 7 else "s") for r in ODD] + [(None, "alpha beta gamma delta epsilon zeta", "en", "s")]
    out = mix(frame(rows), n_words(F.col("text"))).collect()
    assert len(out) == len(rows) and {r["doc_id"] for r in out if not r["copies"]} >= {1, 2, 3}
    got = mixed(frame(rows), n_words(F.col("text")))
    assert got.columns == frame(rows).columns and got.count() == sum(r["copies"] for r in out)
    assert mix(frame([]), n_words(F.col("text"))).count() == 0


# -- sharding --------------------------------------------------------------------------

def test_sharding_shuffles_whole_rows(frame, tmp_path):
    from loadstats.llm.sharding import shard
    rows = [*ODD, *((100 + i, f"text {i}") for i in range(300))]
    docs = frame(rows)
    out = shard(docs, str(tmp_path / "a"), bucket_bytes=2000)
    got = out.collect()
    assert sorted(((r["doc_id"], r["text"]) for r in got), key=str) == sorted(((r[0], r[1]) for r in rows), key=str)
    assert {"shard_in", "_row", "key", "shard", "slot"} <= set(out.columns)
    slots = {s: sorted(r["slot"] for r in got if r["shard"] == s) for s in range(8)}
    assert all(v == list(range(len(v))) for v in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    place = lambda rs: {(r["doc_id"], r["text"]): (r["shard"], r["slot"]) for r in rs if r["doc_id"] != 4}
    again = shard(docs.repartition(3), str(tmp_path / "b"), bucket_bytes=2000).collect()
    assert place(got) == place(again)
    order = [r["doc_id"] for r in sorted(got, key=lambda r: (r["shard"], r["slot"])) if (r["doc_id"] or 0) >= 100]
    rising = sum(a < b for a, b in zip(order, order[1:]))
    assert 100 < rising < 200           # neither sorted nor reversed
    assert shard(docs.limit(0), str(tmp_path / "c")).count() == 0


def test_sharding_digest(frame):
    from loadstats.llm.sharding import shard_digest
    got = {r["doc_id"]: r for r in shard_digest(frame([(1, None), (2, ""), (3, "né")])).collect()}
    assert [got[i]["size"] for i in (1, 2, 3)] == [1, 1, 4]
    assert got[3]["text_crc32"] == zlib.crc32("né".encode()) and got[1]["text_crc32"] == 0 and got[1]["grown_shard"] is None


# -- components ------------------------------------------------------------------------

@pytest.mark.parametrize("few_edges", [0, 1000])
def test_components_of_paths_stars_and_loops(spark, few_edges):
    from loadstats.llm.common import components
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, i) for i in range(101, 140)] + [(200, 201), (201, 202), (202, 200), (5, 5)]
    got = {r[0]: r[1] for r in components(spark.createDataFrame(edges, "a long, b long"), few_edges=few_edges).collect()}
    assert components(spark.createDataFrame([], "a long, b long"), few_edges=few_edges).count() == 0
    assert got == {**{i: 0 for i in range(61)}, **{i: 100 for i in range(100, 140)}, **{i: 200 for i in (200, 201, 202)}}


# -- worker stores and hashes -------------------------------------------------------------

def test_span_hashes_are_independent():
    """The Thue-Morse sequence of two words and its complement collide modulo 2**64, not modulo a prime."""
    from loadstats.llm.substring_dedup import PrimeRolling, Rolling, _hashes
    n = 2048
    bits = [bin(i).count("1") & 1 for i in range(n)]
    one, two = _hashes([b"ab"[b:b + 1] for b in bits]), _hashes([b"ba"[b:b + 1] for b in bits])
    span = np.array([0]), np.array([n])
    old = Rolling(0x9E3779B97F4A7C15, 0)
    assert old.spans(old.sums(one[:, 0]), *span) == old.spans(old.sums(two[:, 0]), *span)
    new = PrimeRolling((1_111_111_121, 1_828_174_637))
    assert new.spans(new.sums(one[:, 1]), *span) != new.spans(new.sums(two[:, 1]), *span)
    # the same words hash alike wherever they stand
    rng = np.random.default_rng(3)
    h = rng.integers(0, 1 << 63, 500, dtype=np.uint64)
    a, b = np.concatenate([h[:100], h[200:260]]), np.concatenate([h[300:307], h[200:260], h[:5]])
    assert new.spans(new.sums(a), np.array([100]), np.array([160])) == new.spans(new.sums(b), np.array([7]), np.array([67]))
    lots = new.spans(new.sums(h), np.arange(440), np.arange(440) + 50)
    assert len(set(lots.tolist())) == 440


def test_word_hasher_forgets_and_agrees():
    from loadstats.llm.common import WordHasher, releasing, word_hasher
    small, big = WordHasher(most_held=10, most_bytes=200), WordHasher()
    rng = random.Random(2)
    for _ in range(50):
        words = [("w" * rng.randint(1, 90) + str(rng.randint(0, 40))).encode() for _ in range(30)]
        assert (small.both(words) == big.both(words)).all()
        assert len(small._row) <= 40 and (small(words) == small.both(words)[:, 0]).all()
    word_hasher()([b"held"])
    assert list(releasing(lambda b: iter(b))([1, 2])) == [1, 2] and not word_hasher()._row


def test_shards_scatter_one_id_by_its_texts(spark, tmp_path):
    from loadstats.llm.sharding import shard
    rows = [(7, f"text {i} " * 20) for i in range(600)] + [(None, f"other {i} " * 20) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = shard(docs, str(tmp_path / "s"), bucket_bytes=20_000).collect()
    assert sorted((r.doc_id or 0, r.text) for r in got) == sorted((i or 0, t) for i, t in rows)
    for s in range(8):
        slots = sorted(r.slot for r in got if r.shard == s)
        assert slots == list(range(150))
        assert 40 < sum(r.doc_id == 7 for r in got if r.shard == s) < 110
