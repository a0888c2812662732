"""Token alignment, fill-in-middle and toxicity."""

import random
import zlib
from collections import Counter
from hashlib import sha256

import numpy as np
import pytest
from conftest_llm import ODD
from pyspark.sql import functions as F

from loadstats.llm.queries import tokenizer_path

A_FILE, B_FILE = "byte_bpe_50k.json", "piece_bpe_32k.model"


# -- alignment -------------------------------------------------------------------------

@pytest.fixture(scope="module")
def aligner():
    from loadstats.llm.token_alignment import Aligner
    return Aligner(tokenizer_path(A_FILE), tokenizer_path(B_FILE))


@pytest.fixture(scope="module")
def libraries():
    import sentencepiece
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(tokenizer_path(A_FILE))
    t.encode_special_tokens = True
    return t, sentencepiece.SentencePieceProcessor(model_file=tokenizer_path(B_FILE))


def brute_align(aligner, libraries, text):
    """(a ids, b ids, links, groups) from the libraries' ids of the whole text, all pairs tried."""
    if not text:
        return [], [], [], ""
    a, b = libraries[0].encode(" " + text, add_special_tokens=False).ids, libraries[1].encode(text)
    raw, spans = (" " + text).encode(), []
    for ids, entries in ((a, aligner.a_bytes), (b, aligner.b_bytes)):
        ends = np.cumsum([len(entries[i]) for i in ids]).tolist()
        if b"".join(entries[i] for i in ids) != raw:
            return [], [], [], ""
        spans.append(list(zip([0] + ends, ends, strict=False)))
    links = [(i, j) for i, (s, e) in enumerate(spans[0]) for j, (u, v) in enumerate(spans[1]) if max(s, u) < min(e, v)]
    groups, i, j = [], 0, 0
    for c in sorted({e for _, e in spans[0]} & {e for _, e in spans[1]}):
        n, m = sum(e <= c for _, e in spans[0]), sum(e <= c for _, e in spans[1])
        groups.append(",".join(map(str, a[i:n])) + "|" + ",".join(map(str, b[j:m])))
        i, j = n, m
    return a, b, links, ";".join(groups)


def odd_texts(n=400, seed=3):
    rng = random.Random(seed)
    bits = ["a", "b", " ", "  ", "\n", "\t", "é", "界", "🙂", "the", "12", "'s", "<|endoftext|>", "<s>", "▁", "\r",
            "é", "\x1c", "<unk>", "　", "<0x41>", " ", "http://x.y/z"]
    return ["".join(rng.choice(bits) for _ in range(rng.randint(0, 25))) for _ in range(n)] + [None, "", " ", "  ", "a ", " a"]


def test_merge_path_equals_plain_merge():
    from loadstats.llm.token_alignment import merge_path
    rng = np.random.default_rng(1)
    for piece in (1, 2, 7, 64):
        for _ in range(60):
            n = int(rng.integers(1, 60))
            a = np.append(np.flatnonzero(rng.random(n) < rng.random()) + 1, n + 1)
            b = np.append(np.flatnonzero(rng.random(n) < rng.random()) + 1, n + 1)
            la, lb, ga, gb = merge_path(a, b, piece)
            sa, sb = np.append(0, a[:-1]), np.append(0, b[:-1])
            want = [(i, j) for i in range(len(a)) for j in range(len(b)) if max(sa[i], sb[j]) < min(a[i], b[j])]
            assert list(zip(la.tolist(), lb.tolist())) == want
            common = np.intersect1d(a, b)
            assert ga.tolist() == np.searchsorted(common, a).tolist() and gb.tolist() == np.searchsorted(common, b).tolist()


def test_alignment_equals_brute_force(aligner, libraries):
    texts = odd_texts()
    m = aligner.align(texts)
    groups = aligner.group_texts(m)
    a_end, b_end, l_end = (np.cumsum(m[k]) for k in ("an", "bn", "ln"))
    for k, t in enumerate(texts):
        a, b, links, text = brute_align(aligner, libraries, t)
        assert m["a"][a_end[k] - m["an"][k]:a_end[k]].tolist() == a
        assert m["b"][b_end[k] - m["bn"][k]:b_end[k]].tolist() == b
        at = slice(l_end[k] - m["ln"][k], l_end[k])
        assert sorted(zip((m["la"][at] - (a_end[k] - m["an"][k])).tolist(), (m["lb"][at] - (b_end[k] - m["bn"][k])).tolist())) == links
        assert bytes(groups[k]).decode() == text and m["gn"][k] == (text.count(";") + 1 if text else 0)


@pytest.mark.parametrize("common", [1_000_000, 3])
def test_alignment_digest(spark, frame, aligner, libraries, common):
    from loadstats.llm.token_alignment import align, alignment_digest
    files = tokenizer_path(A_FILE), tokenizer_path(B_FILE)
    rows = [r for r in ODD if r[0] != 7] + [(20 + k, t) for k, t in enumerate(odd_texts(60))]
    docs = frame(rows)
    count, held = Counter(), []
    for _, t in rows:
        a, b, links, text = brute_align(aligner, libraries, t)
        pairs = [(a[i], b[j]) for i, j in links]
        held.append((a, b, pairs, text))
        count.update(pairs)
    most = Counter()
    for (_, b), n in count.items():
        most[b] = max(most[b], n)
    want = sorted((str(r[0]), len(a), len(b), text.count(";") + bool(text), len(p), sum(count[x] == most[x[1]] for x in p),
                   sum(count[x] for x in p), sha256(text.encode()).hexdigest() if text else "")
                  for r, (a, b, p, text) in zip(rows, held))
    got = alignment_digest(docs, *files, common_pairs=common).collect()
    assert sorted((str(r[0]), *r[1:]) for r in got) == want
    assert alignment_digest(docs.limit(0), *files).count() == 0
    full = align(docs.where("doc_id = 6"), *files).first()
    assert max(full.a_group) == max(full.b_group) and len(full.link_a) == len(full.link_b) and full.n == 6


# -- fill in the middle ------------------------------------------------------------------

def test_rotation_and_restoring():
    from loadstats.llm.fill_in_middle import PLAIN, PSM, SPM, restore, rotate, transform
    rng = random.Random(4)
    for _ in range(200):
        b = bytes(rng.randrange(256) for _ in range(rng.choice([0, 1, 5, 40, 200_001]) if rng.random() < 0.1 else rng.randrange(30)))
        lo, mid, hi = sorted(rng.randint(0, len(b)) for _ in range(3))
        buf = bytearray(b)
        rotate(buf, lo, mid, hi)
        assert bytes(buf) == b[:lo] + b[mid:hi] + b[lo:mid] + b[hi:]
    for _ in range(600):
        t = "".join(rng.choice(["a", "é", "界", "🙂", "<", ">", "P", "S", "M", "\n"]) for _ in range(rng.randint(1, 30)))
        if any(s in t for s in ("<P>", "<S>", "<M>")):
            continue
        i, j = sorted(rng.randint(0, len(t)) for _ in range(2))
        for form, want in ((PLAIN, t), (PSM, f"<P>{t[:i]}<S>{t[j:]}<M>{t[i:j]}"), (SPM, f"<S>{t[j:]}<P>{t[:i]}<M>{t[i:j]}")):
            out = transform(t.encode(), form, i, j - i)
            assert out.decode() == want and restore(bytes(out), form) == t.encode()


def test_fill_in_middle(spark, frame):
    from loadstats.llm.fill_in_middle import fill_in_middle, restored
    rows = ODD + [(30 + k, ("é界" * k + f" text {k} ") * (k % 7)) for k in range(300)] + [(900, "a <S> b"), (901, "x" * 70_000 + "é")]
    got = restored(fill_in_middle(frame(rows))).collect()
    assert len(got) == len(rows)
    forms = Counter(r.form for r in got)
    assert min(forms["plain"], forms["psm"], forms["spm"]) > 15 and forms["psm"] > 2.5 * forms["spm"]
    by = {}
    for r in got:
        t = r.text or ""
        assert r.restored == t and r["score"] == 0
        h = sha256(f"1:{'' if r.doc_id is None else r.doc_id}".encode()).hexdigest()
        h1, h2, h3, h4 = (int(h[k:k + 8], 16) for k in (0, 8, 16, 24))
        i, j = sorted((h1 % (len(t) + 1), h2 % (len(t) + 1)))
        if not t or "<S>" in t or h3 % 100 >= 90:
            assert (r.form, r.prefix_chars, r.fim_text) == ("plain", None, t)
        else:
            want = f"<S>{t[j:]}<P>{t[:i]}<M>{t[i:j]}" if h4 % 100 < 20 else f"<P>{t[:i]}<S>{t[j:]}<M>{t[i:j]}"
            assert (r.fim_text, r.prefix_chars, r.middle_chars) == (want, i, j - i)
        by.setdefault((r.doc_id, r.text), set()).add(r.fim_text)
    assert all(len(v) == 1 for v in by.values())
    assert fill_in_middle(frame(ODD).limit(0)).count() == 0


# -- toxicity ----------------------------------------------------------------------------

def slow_logit(model, text):
    """Word by word, n-gram by n-gram, with the vectors themselves."""
    from loadstats.llm.toxicity import BLANKS, subwords
    words, total = 0, np.zeros(model.embed.shape[1])
    for w in "".join(" " if c.isspace() or c in ".,;:!?\"()[]{}" else c for c in text.lower()).split():
        rows, _, n = subwords(w, len(model.embed))
        assert n == 1 and len(rows) == 1 + sum(max(0, len(w) + 2 - k + 1) for k in (3, 4, 5, 6))
        total += model.embed[rows].mean(axis=0)
        words += 1
    v = total / (words + BLANKS)
    z = model.out @ v + model.bias
    return z[1] - z[0]


def toxic_rows(n, seed=8):
    rng = random.Random(seed)
    calm = ["river", "stone", "paper", "green", "window", "walks", "under", "letter", "morning", "wheel"]
    rude = ["grubnak", "fozzler", "blimwit"]
    rows = []
    for k in range(n):
        words = [rng.choice(calm) + rng.choice(["", "s", "ed", "ing"]) for _ in range(rng.randint(5, 200))]
        bad = k % 5 == 0
        if bad:
            for _ in range(max(1, len(words) // 40)):
                w = rng.choice(rude)
                at = rng.randrange(len(w))
                words[rng.randrange(len(words))] = w[:at] + rng.choice("xyz") + w[at:] if rng.random() < 0.5 else w
        rows.append((k, " ".join(words), int(bad)))
    return rows


@pytest.fixture(scope="module")
def toxic_model():
    from loadstats.llm.toxicity import SubwordSoftmax
    rows = toxic_rows(500)
    return SubwordSoftmax(buckets=1 << 14).fit([r[1] for r in rows], [r[2] for r in rows])


def test_toxicity_score_is_the_softmax_of_the_average(toxic_model):
    for t in ["a calm river", "GRUBNAK, fozzler!", "é界 　x", "", *[r[1] for r in toxic_rows(20, 5)]]:
        assert toxic_model.score(t) == pytest.approx(1 / (1 + np.exp(-slow_logit(toxic_model, t))), abs=1e-4)
    long = " ".join(r[1] for r in toxic_rows(400, 6))
    assert len(long) > 2 * 131072 and toxic_model.score(long) == pytest.approx(1 / (1 + np.exp(-slow_logit(toxic_model, long))), abs=1e-3)


def test_toxicity_catches_unseen_misspellings(toxic_model):
    held = toxic_rows(300, 99)
    score = np.array([toxic_model.score(r[1]) for r in held])
    bad = np.array([r[2] for r in held]) == 1
    assert (score[bad] >= 0.3).mean() >= 0.9 and (score[~bad] >= 0.3).mean() < 0.02
    calm = "river stone paper green window walks under letter"
    assert toxic_model.score(calm) < 0.3 < toxic_model.score(calm + " grubnnak fozzlerr bliimwit")


def test_toxicity_digest(spark, frame):
    from loadstats.llm.toxicity import labelled_draw, toxicity_digest
    rows = toxic_rows(600)
    labels = spark.createDataFrame([(r[0], 1, r[2]) for r in rows] + [(3, 1, 1), (3, 1, 0), (None, 1, 1), (4, 1, None)],
                                   "doc_id long, quality int, toxic int")
    docs = frame([(r[0], r[1]) for r in rows] + [(10_000 + (r[0] or 0), r[1]) for r in ODD] + [(None, None)])
    got = toxicity_digest(docs, labels).collect()
    assert len(got) == len(rows) + len(ODD) + 1
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    truth = {r[0]: r[2] for r in rows}
    for r in got:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
    judged = [(truth[r.doc_id], r.predicted) for r in got if r.held_out and r.doc_id in truth]
    assert np.mean([p for y, p in judged if y]) > 0.9 and np.mean([p for y, p in judged if not y]) < 0.03
    texts, y, w = labelled_draw(docs, labels, "toxic", may_learn=F.col("doc_id") != 3, per_class=40)
    assert 15 < y.count(1) < 70 and 15 < y.count(0) < 70 and sum(w) == pytest.approx(len(y))
    assert sum(a for a, b in zip(w, y) if b) / len(y) == pytest.approx(120 / 599, abs=0.01)
    empty = toxicity_digest(docs.limit(0), labels.limit(0))
    assert empty.count() == 0 and {r.score for r in toxicity_digest(docs.limit(5), labels.limit(0)).collect()} == {0.5}
