"""Codecs, vectors, the classifier and the pipeline."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from conftest_llm import ODD
from pyspark.sql import functions as F
from test_text_operators import TONGUES, brute_components, brute_removed, prose


# -- SentencePiece ---------------------------------------------------------------------

@pytest.fixture(scope="module")
def vocab():
    from loadstats.llm.queries import tokenizer_path
    from loadstats.llm.sentencepiece_codec import vocabulary
    return vocabulary(tokenizer_path("piece_bpe_32k.model"))


def all_paths(v, text):
    s, out = " " + text, []

    def go(i, score, ids):
        if i == len(s):
            out.append((score, tuple(ids)))
            return
        for j in range(i + 1, len(s) + 1):
            if s[i:j] in v.id:
                go(j, score + v.score[s[i:j]], ids + [v.id[s[i:j]]])
        if s[i] not in v.id:
            raw = s[i].encode()
            go(i + 1, score + v.byte_score * len(raw), ids + [v.byte[b] for b in raw])
    go(0, 0.0, [])
    return sorted(out, key=lambda x: -x[0])


def test_n_best_equals_all_segmentations(vocab):
    rng = random.Random(1)
    for _ in range(150):
        text = "".join(rng.choice("ab the\n  öx▁界") for _ in range(rng.randint(1, 10)))
        paths = all_paths(vocab, text)
        score = {p: s for s, p in paths}
        ids, scores, others = vocab.encode([text], 4)[0]
        ways = [tuple(ids.tolist())]
        for way in others:
            w = list(ways[0])
            for at, n, new in sorted(way, reverse=True):
                w[at:at + n] = new
            ways.append(tuple(w))
        assert np.allclose(scores, [s for s, _ in paths[:4]]) and len(set(ways)) == len(ways) == len(scores)
        assert all(score[w] == pytest.approx(s) for w, s in zip(ways, scores))
        assert vocab.decode(pa.array([list(w) for w in ways], pa.list_(pa.int32()))).to_pylist() == [text] * len(ways)


@pytest.mark.parametrize("text, seconds", [("z" * 10_000, 5), ("".join(random.Random(9).choices("0123456789abcdef", k=100_000)), 20),
                                           ("".join(random.Random(8).choices("abcdefghijklmnopqrst", k=1_000_000)), 90)])
def test_long_texts_without_a_space_end(vocab, text, seconds):
    import time
    began = time.monotonic()
    ids, scores, others = vocab.encode([text])[0]
    assert time.monotonic() - began < seconds
    assert scores[0] == pytest.approx(vocab.forward(" " + text)[-1], rel=1e-12) and scores == sorted(scores, reverse=True)
    assert len(scores) == 4 and vocab.decode(pa.array([ids.tolist()], pa.list_(pa.int32()))).to_pylist() == [text]
    for way in others:
        w = ids.tolist()
        for at, n, new in sorted(way, reverse=True):
            w[at:at + n] = new
        assert w != ids.tolist() and vocab.decode(pa.array([w], pa.list_(pa.int32()))).to_pylist() == [text]


def test_n_best_of_long_runs_equal_dynamic_programming(vocab):
    """N best scores of texts too long to list every path: the N best of each place, merged."""
    rng = random.Random(12)
    for text in ["z" * 60, "aaabbb" * 12, "".join(rng.choice("thean") for _ in range(80))]:
        part, n = " " + text, 4
        into = vocab._lattice(part)
        tops = [[0.0]]
        for edges in into[1:]:
            tops.append(sorted((t + s for i, s, _ in edges for t in tops[i]), reverse=True)[:n])
        got = vocab.search(part, n)
        assert [s for s, _ in got] == pytest.approx(tops[-1], rel=1e-12) and len({p for _, p in got}) == n


def test_batched_pass_equals_search(vocab):
    """The numpy pass over many parts finds the scores and gaps of the search of one part."""
    rng = random.Random(5)
    parts = [" " + "".join(rng.choice("abcdeéñ,.\nTHE|!") for _ in range(rng.randint(1, 12))) for _ in range(200)]
    vocab.encode([p[1:] for p in parts], 2)
    for p in parts:
        for one in vocab.parts_of(p[1:]):
            row = vocab._held.row[one]
            scores = [s for s, _ in vocab.search(" " + one, 2)] + [-float("inf")]
            assert vocab._value[row] == pytest.approx([scores[0], scores[0] - scores[1]], abs=1e-6)


def test_codec_digest_round_trips(frame):
    from loadstats.llm.queries import tokenizer_path
    from loadstats.llm.sentencepiece_codec import codec_digest, decode, encode
    model = tokenizer_path("piece_bpe_32k.model")
    rows = [*ODD, (50, " two  spaces "), (51, "日本 ▁ ünï\x00\r\n"), (52, "   "), (53, "x" * 70)]
    got = codec_digest(frame(rows), model).collect()
    assert len(got) == len(rows) and all(r["round_trip"] for r in got)
    by = {r["doc_id"]: r for r in got}
    assert by[1]["n_pieces"] == by[2]["n_pieces"] == 0 and by[1]["best_score"] == 0.0
    coded = encode(frame(rows), model, n_best=1)
    assert coded.columns[-3:] == ["ids", "scores", "others"] and coded.where(F.size("scores") > 1).count() == 0
    null = decode(coded.withColumn("ids", F.when(F.col("doc_id") != 2, F.col("ids"))), model)
    assert null.where("doc_id = 2 AND decoded IS NULL").count() == 1
    assert codec_digest(frame([]), model).count() == 0


def test_decode_is_an_expression_and_equals_the_vocabulary(spark, vocab):
    """It starts no Python worker beside the one that encodes; also for ids that are no text."""
    from loadstats.llm.queries import tokenizer_path
    from loadstats.llm.sentencepiece_codec import decode
    rng = random.Random(8)
    rows = [(i, [rng.choice((rng.randrange(3, 259), rng.randrange(32_000), rng.randrange(6)))
                 for _ in range(rng.randrange(30))]) for i in range(400)] + [(400, None), (401, [])]
    made = decode(spark.createDataFrame(rows, "doc_id long, ids array<int>"), tokenizer_path("piece_bpe_32k.model"))
    import contextlib
    import io
    with contextlib.redirect_stdout(io.StringIO()) as said:
        made.explain("formatted")
    assert "InArrow" not in said.getvalue() and made.columns == ["doc_id", "ids", "decoded"]
    want = vocab.decode(pa.array([ids for _, ids in rows], pa.list_(pa.int32()))).to_pylist()
    assert {r.doc_id: r.decoded for r in made.collect()} == {i: w for (i, _), w in zip(rows, want, strict=True)}


# -- token files -----------------------------------------------------------------------

def test_wavelet_matrix_against_arrays():
    from loadstats.llm.token_files import BLOCK, WaveletMatrix
    rng = np.random.default_rng(3)
    for n, top in ((0, 1), (1, 1), (7, 3), (1000, 50257), (8 * BLOCK + 5, 300), (30_000, 2)):
        ids = rng.integers(0, top, n)
        w = WaveletMatrix(WaveletMatrix.pack(ids, np.array([3, 9]), np.array([n, 0])))
        assert (w.all_ids() == ids).all() and [a.tolist() for a in w.documents()] == [[3, 9], [n, 0], [True, True]]
        for i in rng.integers(0, n, 20) if n else []:
            assert w.access(int(i)) == ids[i]
            t = int(ids[i])
            where = np.flatnonzero(ids == t)
            assert w.count(t) == len(where) and w.count(t, int(i)) == (where < i).sum()
            k = int(rng.integers(0, len(where)))
            assert w.occurrence(t, k) == where[k]
        assert w.count(60_000) == 0
        with pytest.raises(IndexError):
            w.access(n)
    with pytest.raises(ValueError):
        WaveletMatrix(b"nothing")


def test_encoder_equals_the_library():
    from loadstats.llm.queries import tokenizer_path
    from loadstats.llm.token_files import Encoder
    e, rng = Encoder(tokenizer_path("byte_bpe_50k.json"), most_held=300), random.Random(2)
    bits = ["a", "B", " ", "  ", "\n", "\t", ".", "'s", "é", "1", "|", " ", "\x1c", "界", "<|endoftext|>", "\r", " \n ", "word"]
    from tokenizers import Tokenizer
    library = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))       # as the file defines it
    want = lambda t: library.encode(t, add_special_tokens=False).ids + [0]
    assert want("a <|endoftext|> b") == [64, 220, 50256, 275, 0]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 12))) for _ in range(2500)]
    for text in texts:
        assert e([text], 0)[0].tolist() == want(text)
    ids, n = Encoder(tokenizer_path("byte_bpe_50k.json"))(texts, 0)
    assert ids.tolist() == [i for t in texts for i in want(t)] and n.tolist() == [len(want(t)) for t in texts]


def test_encoder_takes_a_column_and_encodes_each_match_once():
    import pyarrow as pa
    from tokenizers import Tokenizer

    from loadstats.llm.queries import tokenizer_path
    from loadstats.llm.token_files import Encoder
    path, rng = tokenizer_path("byte_bpe_50k.json"), random.Random(5)
    words = ["".join(rng.choice("abcdé1") for _ in range(9)) + rng.choice(["", ",", "\n", "."]) for _ in range(400)]
    texts = [None, "", " ", "a  b ", "x <|endoftext|> y", *(" ".join(rng.choices(words, k=30)) for _ in range(700))]
    e, sent = Encoder(path), []
    encode = e._encode
    e._encode = lambda matches: (sent.extend(matches), encode(matches))
    column = pa.chunked_array([pa.array(texts[:3]), pa.array(texts[3:400]), pa.array([], pa.string()), pa.array(texts[400:])])
    ids, n = e(column, 0)
    library = Tokenizer.from_file(path)
    want = [library.encode(t or "", add_special_tokens=False).ids + [0] for t in texts]
    assert ids.tolist() == [i for w in want for i in w] and n.tolist() == list(map(len, want))
    assert len(sent) == len(set(sent)) > 400


def test_matches_go_to_the_model_itself():
    """Only first words and white space are encoded as texts; marks and letters of all kinds come out alike."""
    from tokenizers import Tokenizer

    from loadstats.llm.queries import tokenizer_path
    from loadstats.llm.token_files import Encoder
    path, rng = tokenizer_path("byte_bpe_50k.json"), random.Random(6)
    bits = ["ab", "É", "界", "e\u0301", "ʰ", "\u00ad", "\x7f", "\x1f", "😀", "9", "٣", "'", "'ll", "don't"]
    words = ["".join(rng.choices(bits, k=rng.randint(1, 3))) + rng.choice(["", *".,;:!?\"()-'’…\n", "?!", ".\nThe"])
             for _ in range(600)] + [m for m in ".,;:!?\"()-"]
    texts = ["first " + " ".join(rng.choices(words, k=40)) for _ in range(80)] + [f"x {w}" for w in words]
    e, whole = Encoder(path), []
    plain = e._plain
    e._plain = lambda text: (whole.append(text), plain(text))[1]
    ids, n = e(texts, 0)
    library = Tokenizer.from_file(path)
    want = [library.encode(t, add_special_tokens=False).ids + [0] for t in texts]
    assert ids.tolist() == [i for w in want for i in w] and n.tolist() == list(map(len, want))
    odd = {t for t in texts if " \x1f" in t}       # a space that white space follows: encoded as a whole text up to a word
    assert all(t in ("first", "x") or t.isspace() or any(o.startswith(t) for o in odd) for t in whole)


def test_encoder_takes_runs_of_marks_and_batches_of_texts():
    import gc
    import string

    import pyarrow as pa
    from tokenizers import Tokenizer

    from loadstats.llm.queries import tokenizer_path
    from loadstats.llm.token_files import Encoder, WaveletMatrix
    path, rng = tokenizer_path("byte_bpe_50k.json"), random.Random(8)
    library = Tokenizer.from_file(path)
    want = lambda t: library.encode(t or "", add_special_tokens=False).ids + [0]
    e, asked = Encoder(path), []
    pattern = e._matches
    e._matches = lambda w: asked.append(w) or pattern(w)
    ends = ["", "%%%", "***", "!!", ".", "'", "_", "<|", "$`~", "'s", "\u0301", "7", "\u2026", "\nBe."]
    texts = [None, "", *(" ".join("".join(rng.choices("abzA\u00e9\u00df", k=3)) + rng.choice(ends)
                                  for _ in range(rng.randint(1, 9))) for _ in range(700))]
    for given in (texts, pa.chunked_array([pa.array(texts[:300]), pa.array(texts[300:])])):    # over 256 texts
        ids, n = e(given, 0)
        assert ids.dtype == np.uint32 and ids.tolist() == [i for t in texts for i in want(t)]
        assert n.tolist() == [len(want(t)) for t in texts]
    assert [a.tolist() for a in e([], 0)] == [[], []] and gc.isenabled()
    # letters with marks up to the word's end do not need the pattern
    assert asked and not [w for w in asked if w[1:].rstrip(string.punctuation).isalpha()]
    matrix = WaveletMatrix(WaveletMatrix.pack(ids, np.arange(len(n)), n))
    assert (matrix.all_ids() == ids).all() and [matrix.access(i) for i in range(9)] == ids[:9].tolist()
    none = np.empty(0, np.uint32)
    assert not len(WaveletMatrix(WaveletMatrix.pack(none, none, none)).all_ids())


def test_token_files_split_hot_and_missing_ids(spark, tmp_path):
    """One id, and NULL, with half of the rows each fill many shards; an id of -2**63 is no NULL."""
    from loadstats.llm.queries import tokenizer_path
    from loadstats.llm.token_files import read_token_files, write_token_files
    rows = [(None if i % 2 else 7, f"text {i % 90} of a hot id") for i in range(400)] + [(-(1 << 63), "least"), (8, None)]
    manifest = write_token_files(spark.createDataFrame(rows, "doc_id long, text string"), tokenizer_path("byte_bpe_50k.json"),
                                 str(tmp_path / "hot"), shard_bytes=1000)
    parts = [r.n_docs for r in manifest.collect()]
    assert len(parts) > 6 and max(parts) < 150
    got = read_token_files(manifest).collect()
    count = {i: sum(r.doc_id == i for r in got) for i in (None, 7, 8, -(1 << 63))}
    assert count == {None: 200, 7: 200, 8: 1, -(1 << 63): 1}
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    assert [r.doc_id for r in sorted(got, key=lambda r: r.start)][200] == -(1 << 63)


def test_token_files_round_trip(frame, tmp_path):
    from loadstats.llm.queries import tokenizer_path
    from loadstats.llm.token_files import Encoder, read_token_files, write_token_files
    path = tokenizer_path("byte_bpe_50k.json")
    rows = [*ODD, *((100 - i, f"some text number {i} é") for i in range(60))]
    manifest = write_token_files(frame(rows), path, str(tmp_path / "files"), shard_bytes=400)
    assert manifest.count() > 5 and len(list((tmp_path / "files").iterdir())) >= manifest.count()
    got = [tuple(r) for r in read_token_files(manifest).collect()]
    e, at, want = Encoder(path), 0, []
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = e([t], 0)[0]
        want.append((i, at, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
        at += len(ids)
    assert sorted(got, key=str) == sorted(want, key=str)
    assert read_token_files(write_token_files(frame([]), path, str(tmp_path / "none"))).count() == 0


# -- embeddings ------------------------------------------------------------------------

def test_list_decoding_finds_every_passed_filter():
    from loadstats.llm.spherical_caps import Codes, Plan, plan
    for p in (Plan(12, 2, 9, 0.35, 1), Plan(12, 3, 5, 0.3, 2), plan(500, 8)):
        c = Codes(p)
        x = np.random.default_rng(4).standard_normal((20, p.dim))
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        whole = np.zeros((1, 0))
        for block in c.codes:
            whole = np.concatenate([np.repeat(whole, p.code, axis=0), np.tile(block, (len(whole), 1))], axis=1)
        inner = (x @ c.rotation) @ whole.T
        sure = np.abs(inner - p.alpha) > 1e-9
        for i, numbers in enumerate(c.decode(x)):
            passed = np.zeros(len(whole), dtype=bool)
            passed[numbers] = True
            assert (passed == (inner[i] >= p.alpha))[sure[i]].all()


@pytest.mark.parametrize("n", [1_000_000, 100_000_000])
def test_caps_recall_does_not_fall_with_the_table(n):
    from loadstats.llm.spherical_caps import _codes, _decoded, plans
    codes = _codes(tuple(plans(n, 64)))
    rng = np.random.default_rng(11)
    x, y = rng.standard_normal((2, 300, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y -= (x * y).sum(axis=1, keepdims=True) * x
    c = rng.uniform(0.9, 0.92, (300, 1))
    y = c * x + np.sqrt(1 - c * c) * y / np.linalg.norm(y, axis=1, keepdims=True)
    met = [bool(set(a) & set(b)) for a, b in zip(_decoded(codes, x), _decoded(codes, y))]
    assert sum(met) >= 0.97 * len(met)


def vectors(spark, rows):
    return (spark.createDataFrame(rows, "vec_id long, embedding array<float>")
            .withColumn("id", F.lit("x")).withColumn("unit", F.lit(1)).withColumn("n_links", F.lit(2)))


@pytest.mark.parametrize("tile_rows", [1000, 8])
def test_near_vectors_recall(spark, tile_rows):
    from loadstats.llm.spherical_caps import near_duplicates
    rng = np.random.default_rng(7)
    base = rng.standard_normal((40, 32))
    rows = []
    for i in range(260):
        v = base[i % 40] + rng.standard_normal(32) * rng.choice([0.0, 0.15, 0.3, 0.5, 2.0])
        rows.append((i * 3, [float(x) for x in v * rng.uniform(0.5, 3)]))
    x = np.array([v for _, v in rows], dtype=np.float32).astype(np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = (x @ x.T >= 0.9) & ~np.eye(len(x), dtype=bool)
    got = {r["vec_id"]: r for r in near_duplicates(vectors(spark, rows), tile_rows=tile_rows).collect()}
    links = np.array([got[i]["n_links"] for i, _ in rows])
    assert (links <= near.sum(axis=1)).all() and links.sum() >= 0.97 * near.sum() > 200
    assert all(r["kept"] == (r["component_id"] == i) and r["component_id"] <= i for i, r in got.items())


def test_sketches_leave_only_close_calls_open_and_lose_none(spark):
    """Pairs at a hair from the cosine, on both sides: whatever a sketch decides is right, what it
    leaves open is decided in double precision, and the counts are those of all pairs."""
    from loadstats.llm.spherical_caps import ROUNDING, _sketched, near_duplicates
    rng = np.random.default_rng(3)
    x, y = rng.standard_normal((2, 120, 24))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y -= (x * y).sum(axis=1, keepdims=True) * x
    c = 0.9 + np.repeat([-1e-3, -1e-5, -1e-6, 1e-6, 1e-5, 1e-3], 20)[:, None]
    y = c * x + np.sqrt(1 - c * c) * y / np.linalg.norm(y, axis=1, keepdims=True)
    q, step, off = _sketched(np.concatenate([x, y]))
    s = q * step[:, None]
    whole = np.concatenate([x, y])
    bound = 2 * off.max() + off.max() ** 2 + ROUNDING
    assert np.abs(s @ s.T - whole @ whole.T).max() <= bound < 1e-3
    rows = [(i, v.tolist()) for i, v in enumerate(whole)] + [(1000 + i, v.tolist()) for i, v in enumerate(x[60:80])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r["vec_id"]: r for r in near_duplicates(table).collect()}
    every = np.array([v for _, v in rows])
    want = ((every @ every.T >= 0.9).sum(axis=1) - 1).tolist()
    near = sum(got[i]["n_links"] for i, _ in rows)
    assert all(got[i]["n_links"] <= w for (i, _), w in zip(rows, want, strict=True)) and near >= 0.97 * sum(want)
    assert all(got[i]["n_links"] == got[i + 120]["n_links"] == 0 for i in range(60))
    assert all(got[1000 + i]["n_links"] == got[60 + i]["n_links"] >= 1 for i in range(20))


def test_thousands_of_links_just_above_the_cosine(spark):
    """Recall over the whole operator where it is hardest: 3,000 pairs at 0.90 to 0.92."""
    from loadstats.llm.spherical_caps import near_duplicates
    rng = np.random.default_rng(12)
    x, y = rng.standard_normal((2, 3000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y -= (x * y).sum(axis=1, keepdims=True) * x
    c = rng.uniform(0.9001, 0.92, (3000, 1))
    y = c * x + np.sqrt(1 - c * c) * y / np.linalg.norm(y, axis=1, keepdims=True)
    rows = [(i, v.tolist()) for i, v in enumerate(np.concatenate([x, y]))]
    got = near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    assert got.where("vec_id >= 3000 AND component_id = vec_id - 3000 AND n_links = 1").count() >= 0.97 * 3000
    assert got.agg(F.max("n_links")).first()[0] == 1


def angles(spark, degrees):
    rows = [(i, [float(np.cos(np.radians(d))), float(np.sin(np.radians(d)))]) for i, d in degrees]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>")


def test_a_link_to_a_larger_id_that_has_a_smaller_one_connects(spark):
    """1 and 2 are both linked with 3 but not with each other; 10 to 14 are a chain out of order.
    One filter that all vectors pass holds every pair."""
    from loadstats.llm.spherical_caps import Plan, near_duplicates
    table = angles(spark, [(1, 0), (3, 20), (2, 40), (10, 120), (14, 140), (11, 160), (13, 180), (12, 200), (20, 270)])
    got = {r["vec_id"]: tuple(r)[1:] for r in near_duplicates(table, p=Plan(2, 1, 2, -2.0, 1)).collect()}
    assert got == {1: (1, 1, True), 3: (2, 1, False), 2: (1, 1, False), 10: (1, 10, True), 14: (2, 10, False),
                   11: (2, 10, False), 13: (2, 10, False), 12: (1, 10, False), 20: (0, 20, True)}


@pytest.mark.parametrize("kind", ["float", "double"])
def test_a_cosine_met_exactly_is_a_link(spark, kind):
    """81 + 9 + 9 + 1 = 100, so the cosine with an axis is 9 / 10; 89999 / 100000 falls short."""
    from loadstats.llm.spherical_caps import near_duplicates
    rows = [(1, [10.0, 0.0, 0.0, 0.0]), (2, [9.0, 3.0, 3.0, 1.0]), (3, [0.0, 0.0, 0.0, 7.0]), (4, [-3.0, 0.0, 1.0, 9.0]),
            (5, [-63.0, 0.0, -7.0, 189.0]), (6, [0.0, 2.0, 0.0, 0.0]), (7, [0.0, 9.0, 0.0, -4.3591])]
    got = near_duplicates(spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>")).collect()
    x = np.array([v for _, v in rows])
    near = x @ x.T >= 0.9 * np.sqrt(np.outer((x * x).sum(axis=1), (x * x).sum(axis=1)))
    assert {r["vec_id"]: r["n_links"] for r in got} == {i: int(n) - 1 for (i, _), n in zip(rows, near.sum(axis=1), strict=True)}
    assert near[0, 1]


def test_least_reached_is_that_of_brute_force():
    from loadstats.llm.spherical_caps import _least_reached
    rng = np.random.default_rng(6)
    for n, m in ((2, 1), (50, 20), (50, 45), (300, 280), (300, 2000)):
        ids = rng.choice(10 * n, n, replace=False)
        i, j = rng.integers(0, n, (2, m))
        want, old = ids.copy(), None
        while old is None or (old != want).any():
            old = want.copy()
            for a, b in zip(i, j):
                want[a] = want[b] = min(want[a], want[b])
        assert (_least_reached(ids, i, j) == want).all()


def test_vectors_odd_rows(spark):
    from loadstats.llm.spherical_caps import near_duplicates
    nan, inf = float("nan"), float("inf")
    rows = [(1, None), (2, [0.0, 0.0]), (3, [nan, 1.0]), (4, [inf, 1.0]), (5, [None, 1.0]), (6, []), (None, [1.0, 0.0]),
            (7, [1.0, 0.0]), (8, [2.0, 0.0]), (9, [2.0, 0.0]), (10, [1.0, 0.3]), (11, [0.0, 1.0]), (12, [1.0, 0.0, 0.0]), (7, [1.0, 0.0])]
    got = near_duplicates(vectors(spark, rows)).collect()
    assert len(got) == len(rows)
    by = {r["vec_id"]: tuple(r)[1:] for r in got}
    assert all(by[i] == (0, i, True) for i in (1, 2, 3, 4, 5, 6, 11, 12)) and by[None] == (0, None, None)
    assert by[7] == (4, 7, True) and by[8] == by[9] == (4, 7, False) and by[10] == (4, 7, False)
    assert near_duplicates(vectors(spark, [])).count() == 0
    assert near_duplicates(vectors(spark, [(1, None)])).collect()[0]["kept"]


# -- quality classifier ----------------------------------------------------------------

def test_gradients_agree_with_differences():
    from loadstats.llm.quality_cnn import ByteCNN
    m = ByteCNN(3)
    raw = m._places((prose("en", 120, 3) + "!!").encode())
    g = {k: np.zeros_like(v) for k, v in m.p.items()}
    m._gradients(raw, 1.0, 1.0, g)

    def loss():
        z = m._head(m._chunks(m._blocks(raw)[0])[0])[3]
        return np.log1p(np.exp(-z))
    for k in ("out", "hid", "conv0", "conv", "embed"):
        # along the gradient itself the loss falls by its squared length
        step = 1e-3 / max(1e-6, float(np.abs(g[k]).max()))
        keep = m.p[k].copy()
        before = loss()
        m.p[k] = (keep - step * g[k]).astype(np.float32)
        fall = (before - loss()) / step
        m.p[k] = keep
        assert fall == pytest.approx(float((g[k] ** 2).sum()), rel=0.15), k


def test_chunks_cover_every_block():
    from loadstats.llm.quality_cnn import CHUNK, ByteCNN
    for n in range(1, 30):
        blocks = np.arange(n, dtype=np.float32)[:, None].repeat(2, axis=1)
        for sign in (1, -1):
            c, at = ByteCNN._chunks(sign * blocks, True)
            assert c.max() == (sign * blocks).max() and (np.abs(c[:, 0]) == at[:, 0]).all()
        assert len(c) == max(1, -(-(n - CHUNK) // 3) + 1)


def test_classifier_on_held_out_texts(spark, frame):
    from loadstats.llm.quality_cnn import quality_digest
    rng = random.Random(3)
    rows, labels = [], []
    for i in range(240):
        good = i % 3 > 0
        t = prose(rng.choice(list(TONGUES)), rng.randrange(8, 90), i)
        rows.append((i, t if good else rng.choice([t.upper().replace(" ", "!! "), t.replace(" ", " | ")])))
        labels.append((i, int(good), 0))
    labels += [(None, 1, 0), (0, None, 0), (5000, 1, 1), (1, 0, 0)]
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = quality_digest(frame(rows + ODD[:4]), marks).collect()
    assert len(got) == 244
    held = [r for r in got if r["held_out"] and r["doc_id"] > 3]
    assert 30 < len(held) < 100 and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in held)
    right = np.mean([r["predicted"] == int(r["doc_id"] % 3 > 0) for r in held])
    assert right > 0.9 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in got)
    assert quality_digest(frame([]), marks).count() == 0
    assert quality_digest(frame(ODD), marks.limit(0)).count() == len(ODD)


# -- pipeline --------------------------------------------------------------------------

def test_pipeline_equals_brute_force(spark, frame, tmp_path):
    """All stages in a row, against plain Python for the first three and the properties of the rest."""
    import corpus_pipeline
    rng = random.Random(12)
    rows, texts = [(500, None, "en", "a"), (501, "123 456", "en", "b")], []
    for i in range(80):
        lang = rng.choice(list(TONGUES))
        t = prose(lang, rng.choice((20, 70, 160)), i)
        if texts and i % 4 == 0:
            w = rng.choice(texts).split(" ")
            w[rng.randrange(len(w))] = "changed"
            t = " ".join(w)
        if i % 7 == 0:
            t += " " + prose("en", 55, "shared")
        texts.append(t)
        rows.append((i, t, lang, rng.choice("abc")))
    docs = frame(rows, clash=False)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    kept = {i: t for i, t, *_ in rows if i < 500}
    comp = brute_components(sorted(kept.items()))
    kept = {i: t for i, t in kept.items() if comp[i][1] == i}
    removed = brute_removed(list(kept.items()))
    lengths = {i: n - gone for i, (n, gone, _) in removed.items()}
    assert len(kept) < 75 and sum(gone > 0 for _, gone, _ in removed.values()) > 3
    d = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES[:3]:
        d = stage(spark, d, str(tmp_path))
        assert d.columns == docs.columns, name
    left = {r["doc_id"]: r["text"] for r in d.collect()}
    assert {i: len(t.split()) for i, t in left.items()} == lengths
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    words = sum(lengths[r["doc_id"]] for r in out)
    budget = sum(lengths.values()) * 3 // 2
    assert budget - 220 < words <= budget and all(r["round_trip"] for r in out)
    assert {r["doc_id"] for r in out} <= set(left) and max(map([r["doc_id"] for r in out].count, left)) == 2
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, str(tmp_path)).count() == 0


def test_wavelet_planes_longer_than_a_run():
    import numpy as np

    from loadstats.llm.token_files import RUN, WaveletMatrix
    for n in (RUN - 1, RUN, 3 * RUN + 5):
        ids = np.random.default_rng(n).integers(0, 50_000, n).astype(np.uint16)
        given = ids.copy()
        w = WaveletMatrix(WaveletMatrix.pack(ids, np.array([3]), np.array([n])))
        assert (ids == given).all() and (w.all_ids() == given).all()
        assert [w.access(i) for i in (0, RUN - 2, n - 1)] == given[[0, RUN - 2, n - 1]].tolist()
