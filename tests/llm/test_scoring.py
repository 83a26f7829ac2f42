"""The language model, language identification and tokens."""

import zlib

import numpy as np
import pyarrow as pa
import pytest
from brute import fold, unigram
from conftest import AWKWARD
from pyspark.sql import functions as F

from halyard.llm import cluster, langid, language_model as lm, tokens
from halyard.llm.queries import op1_lm_scoring, op9_token_ids, op10_language_id


@pytest.fixture
def small_model(monkeypatch):
    v = lm.Vocabulary([b"a", b"b", lm.END, b"c"], np.array([9, 5, 4, 1]), 19, 4, np.full(lm.TAIL_CLASSES, 0.3))
    monkeypatch.setattr(lm, "UNITS", 5)
    monkeypatch.setattr(lm, "EMBEDDING", 4)
    model = lm.Model(v, seed=3)
    draw = np.random.default_rng(0)
    model.w = {k: (x + 0.3 * draw.standard_normal(x.shape)).astype(np.float64) for k, x in model.w.items()}
    return model


def _loss(model, code, target, keep):
    hs, *_ = model.states(code, keep, np.zeros((code.shape[1], lm.UNITS)))
    return -model.output(hs[1:].reshape(-1, lm.UNITS).copy(), target.ravel(), False).sum()


def test_gradients_match_differences(small_model):
    draw = np.random.default_rng(1)
    code, target = draw.integers(0, 4 + lm.TAIL_CLASSES, (6, 3)), draw.integers(0, 4 + lm.TAIL_CLASSES, (6, 3))
    keep = np.ones((6, 3), np.float32)
    keep[0] = keep[3, 1] = 0
    hs, start, zr, n = small_model.states(code, keep, np.zeros((3, lm.UNITS), np.float32))
    _, grad, dh = small_model.output(hs[1:].reshape(-1, lm.UNITS).copy(), target.ravel(), True)
    grad |= small_model.backward(code, keep, hs, start, zr, n, dh.reshape(6, 3, lm.UNITS))
    for name, g in grad.items():
        flat = small_model.w[name].reshape(-1)
        for i in draw.choice(len(flat), min(6, len(flat)), replace=False):
            old, step = flat[i], 1e-2
            flat[i] = old + step
            up = _loss(small_model, code, target, keep)
            flat[i] = old - step
            down = _loss(small_model, code, target, keep)
            flat[i] = old
            assert abs((up - down) / (2 * step) - g.reshape(-1)[i]) < 2e-2 + 2e-2 * abs(g.reshape(-1)[i]), name


def test_probabilities_sum_to_one(small_model):
    h = np.random.default_rng(2).standard_normal((1, lm.UNITS)).astype(np.float32)
    every = np.arange(4 + lm.TAIL_CLASSES)
    total = np.exp(small_model.output(np.repeat(h, len(every), 0), every, False)).sum()
    assert abs(total - 1) < 1e-4


def test_state_is_carried_across_windows_and_lanes(small_model, monkeypatch):
    draw = np.random.default_rng(4)
    docs = [draw.integers(0, 4, n).astype(np.uint16) for n in (1, 7, 40, 3, 90, 5)]
    monkeypatch.setattr(lm, "WINDOW", 1000)
    whole = np.array([lm.log10_likelihood(small_model, [d], 2, 1)[0] for d in docs])
    for window, lanes in ((4, 1), (4, 3), (16, 256)):
        monkeypatch.setattr(lm, "WINDOW", window)
        assert np.allclose(lm.log10_likelihood(small_model, docs, 2, lanes), whole, atol=1e-4)


def _plain_likelihood(model, doc, end):
    """One document, one token at a time, straight from the definitions."""
    w, h, total, previous = model.w, np.zeros(lm.UNITS), 0.0, end
    for code in doc.tolist():
        a = w["e"][previous] @ w["wx"] + w["b"]
        gates = 1 / (1 + np.exp(-(h @ w["uzr"] + a[: 2 * lm.UNITS])))
        z, r = gates[: lm.UNITS], gates[lm.UNITS :]
        new = np.tanh((r * h) @ w["un"] + a[2 * lm.UNITS :])
        h = z * h + (1 - z) * new
        classes = h @ w["wc"] + w["bc"]
        c = int(model.class_of(np.array([code]))[0])
        total += classes[c] - np.log(np.exp(classes).sum())
        if code < model.head:
            a, b = int(model.first[c]), int(model.first[c + 1])
            words = h @ w["wo"][:, a:b] + w["bo"][a:b]
            total += words[code - a] - np.log(np.exp(words).sum())
        previous = code
    return total / np.log(10)


def test_likelihood_against_plain_steps(small_model):
    draw = np.random.default_rng(6)
    docs = [draw.integers(0, 4 + lm.TAIL_CLASSES, n).astype(np.uint16) for n in (1, 30, 7, 55)]
    got = lm.log10_likelihood(small_model, docs, 2, 3)
    assert np.allclose(got, [_plain_likelihood(small_model, d, 2) for d in docs], atol=1e-3)


def test_one_long_text_beside_many_short_ones(small_model):
    """Memory follows the tokens, not lanes times the longest text."""
    draw = np.random.default_rng(7)
    docs = [draw.integers(0, 4, n).astype(np.uint16) for n in [20_000, *([9] * 383)]]
    packed = lm._Lanes(docs, lm.LANES, 2)
    held = sum(x.nbytes for x in vars(packed).values() if isinstance(x, np.ndarray))
    assert held < 20 * sum(d.nbytes for d in docs)
    assert max(code.size for _, code, *_ in packed.windows(lm.WINDOW)) <= lm.WINDOW * lm.LANES
    some = [docs[0][:2_000], *docs[1:20]]
    assert np.allclose(lm.log10_likelihood(small_model, some, 2), [lm.log10_likelihood(small_model, [d], 2)[0] for d in some], atol=1e-2)


def test_rows_come_in_bounded_groups(monkeypatch):
    monkeypatch.setattr(lm, "GROUP_BYTES", 40)
    codes = [bytes(2 * n) for n in (3, 4, 30, 1, 1, 9, 9, 2)]
    batches = [pa.RecordBatch.from_arrays([pa.array(range(len(part))), pa.array(part, pa.binary())], ["id", "codes"]) for part in (codes[:2], codes[2:5], codes[5:], [])]
    groups = [t["codes"].to_pylist() for t in lm._groups(batches)]
    assert sum(groups, []) == codes
    assert all(sum(map(len, g)) <= 40 or len(g) == 1 for g in groups)


def test_op1_awkward(awkward):
    train = (F.col("doc_id") % 3 != 0).alias("t")
    got = lm.score_texts(awkward, train).collect()
    own = [i is not None and i % 3 != 0 for i, _ in AWKWARD]
    n, expected = unigram(AWKWARD, own)
    assert {r.train_tokens for r in got} == {n}
    found = sorted((r.n_tokens, r.n_known, round(r.base_score, 4)) for r in got)
    assert found == sorted((a, b, round(c, 4)) for a, b, c in expected)
    assert all(np.isfinite(r.score) and r.score <= 0 for r in got)


def test_op1_nothing_to_learn(awkward, nothing):
    got = lm.score_texts(awkward, F.lit(None).cast("boolean")).collect()
    assert all(r.score == r.base_score and r.train_tokens == 0 and r.n_known == 0 for r in got)
    assert lm.score_texts(nothing, F.lit(True)).count() == 0


def test_op1_query_beats_the_unigram_model(spark, sf_dir):
    rows = {r.doc_id: r for r in op1_lm_scoring(spark, sf_dir).collect()}
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    n, expected = unigram(docs, [fold(i, 10) != 0 for i, _ in docs])
    for (i, _), (size, known, base) in zip(docs, expected):
        r = rows[i]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (size, known, n, fold(i, 10) == 0)
        assert abs(r.base_score - base) < 1e-6 * abs(base)
    held = [r for r in rows.values() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_op10_awkward(spark, awkward, nothing):
    labelled = spark.createDataFrame([(i, f"the house of the {i} man and the dog", "en") for i in range(8)] + [(i, f"das haus der {i} mann und der hund ist", "de") for i in range(8, 16)] + [(99, "x", None)], "doc_id long, text string, lang string")
    filters = langid.fit(labelled)
    assert filters.languages == ["de", "en"]
    got = langid.identify(awkward, filters)
    assert got.columns == [c for c in awkward.columns if c != "score"] + ["lang_pred", "score"]
    by = {r.chunk: r for r in got.collect()}
    for n, (_, text) in enumerate(AWKWARD):
        has = text is not None and any(map(str.isalpha, text))
        assert (by[n].lang_pred == "und") == (not has) and 0 <= by[n].score <= 1
    assert langid.identify(nothing, filters).count() == 0
    none = langid.fit(labelled.where("lang is null"))
    assert {r.lang_pred for r in langid.identify(awkward, none).collect()} == {"und"}


def test_op10_returns_all_languages_of_an_ngram():
    filters = langid.Filters(["de", "en"], "de")
    h, _ = langid.ngrams(pa.array(["the man", "der mann"]))
    filters.add(h, 0)
    h, _ = langid.ngrams(pa.array(["the man"]))
    filters.add(h, 1)
    n, hits = filters.counts(pa.array(["the man", "der mann", ""]))
    assert hits[0].tolist() == [n[0], n[0]] and hits[1][0] > hits[1][1] and n[2] == 0


def test_op10_many_languages():
    names = [f"l{i:02d}" for i in range(12)]
    filters = langid.Filters(names, "l00")
    for i in range(12):
        filters.add(langid.ngrams(pa.array([chr(97 + i) * 3 + "xyz" + chr(97 + i) * 4]))[0], i)
    said, _ = filters.decide(pa.array(["eeexyzeeee", "lllxyzllll"]))
    assert said == ["l04", "l11"]


def test_op10_more_than_64_and_rare_languages(spark):
    """Each of 150 languages has an alphabet of its own; the rarest one document."""
    letters = [[chr(0x4E00 + 40 * i + k) for k in range(40)] for i in range(150)]
    text = lambda i, n: " ".join("".join(letters[i][(n + j + k) % 40] for k in range(4)) for j in range(30))
    rows = [(1000 * i + n, text(i, n), f"l{i:03d}") for i in range(150) for n in range((1, 2, 12)[i % 3])]
    filters = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert filters.languages == [f"l{i:03d}" for i in range(150)]
    asked = spark.createDataFrame([(i, text(i, 5)) for i in range(150)], "doc_id long, text string")
    got = {r.doc_id: r.lang_pred for r in langid.identify(asked, filters).collect()}
    assert got == {i: f"l{i:03d}" for i in range(150)}


def test_op10_query_on_held_out(spark, sf_dir):
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang").collect()}
    rows = op10_language_id(spark, sf_dir).collect()
    held = [r for r in rows if r.held_out]
    assert len(rows) == len(lang) and all(r.held_out == (fold(r.doc_id, 4) == 2) for r in rows)
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in held]) > 0.95


def _tokenizer():
    from tokenizers import Tokenizer

    public_tokenizers = pytest.importorskip("public_tokenizers")
    path = public_tokenizers.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return path, t


def _expected(t, rows):
    at, out = 0, []
    for i, text in rows:
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        out.append((i, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    return out


def test_op9_awkward(spark, awkward, nothing):
    path, t = _tokenizer()
    folder = cluster.shared_dir(spark)
    tokens.write_tokens(awkward, folder, path, file_tokens=500)
    got = sorted(tuple(r) for r in tokens.read_tokens(spark, folder).select("start", "n_tokens", "ids_crc32", "doc_id").collect())
    rows = sorted(AWKWARD, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode()))
    assert got == [(s, n, c, i) for i, s, n, c in _expected(t, rows)]
    folder = cluster.shared_dir(spark)
    tokens.write_tokens(nothing, folder, path)
    assert tokens.read_tokens(spark, folder).count() == 0


def test_op9_pieces_encode_alone_as_in_place():
    path, t = _tokenizer()
    texts = ["a  b", " lead", "trail ", "tab\t x", "new\n line", "it's  we'll 've", "é è  ñ", "x\xa0 y", "  z", "1 2  3\n\n 4", "<|endoftext|> a", "", "don't\r\n stop", "ab cd ef", "日本 語", "a \x1c b", "rock'n'roll o'clock they'll'd x's,y 's !!'s a,'re b\\c_d e--f (g) [h]i'", "Ã\x85 x", "𝔘 𝔫"]
    encoder = tokens.Encoder(path)
    for _ in range(2):  # the second time from memory
        flat, counts = encoder.encode(pa.array(texts))
        at = 0
        for text, n in zip(texts, counts.tolist()):
            assert flat[at : at + n].tolist() == t.encode(text, add_special_tokens=False).ids, text
            at += n


def test_op9_file_maps_into_memory(spark, tmp_path):
    path, t = _tokenizer()
    docs = spark.createDataFrame([(2, "b c"), (1, "a")], "doc_id long, text string").coalesce(1)
    tokens.write_tokens(docs, f"file://{tmp_path}/t", path)
    for part in sorted((tmp_path / "t").glob("part-*")):
        ids, offsets, doc_ids, _ = tokens.parse_part(part.read_bytes())
        if len(ids):
            assert all((a == b).all() for a, b in zip(tokens.map_part(str(part))[:3], (ids, offsets, doc_ids)))
            mapped = np.memmap(part, ids.dtype, "r", shape=len(ids))
            assert (mapped == ids).all() and offsets[-1] == len(ids) and len(doc_ids) == len(offsets) - 1
    with pytest.raises(ValueError):
        tokens.parse_part(part.read_bytes()[1:])
    got = tokens.read_tokens(spark, f"file://{tmp_path}/t", with_ids=True).orderBy("start").collect()
    assert [list(r.ids) for r in got] == [[*t.encode("a").ids, 0], [*t.encode("b c").ids, 0]]


def test_op9_query(spark, sf_dir):
    path, t = _tokenizer()
    rows = sorted(tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect())
    assert sorted(map(tuple, op9_token_ids(spark, sf_dir).collect())) == _expected(t, rows)


SPECIAL = ["a <|endoftext|> b", "<|endoftext|>", "<|endoftext|><|endoftext|>x", "end.<|endoftext|>", "", "a<|endoftext|", "|>", "<|endoftext|", "|> x's<|endoftext|>\n\n é<|endoftext|> ñ ", "plain text", "<|<|endoftext|>|>"]


def test_op9_added_tokens_as_the_library_does_by_default(spark):
    from tokenizers import Tokenizer

    path, _ = _tokenizer()
    t = Tokenizer.from_file(path)
    assert t.encode(SPECIAL[0], add_special_tokens=False).ids == [64, 220, 50256, 275]
    folder = cluster.shared_dir(spark)
    rows = [*enumerate(SPECIAL), (len(SPECIAL), None), (len(SPECIAL) + 1, "after all")]
    tokens.write_tokens(spark.createDataFrame(rows, "doc_id long, text string"), folder, path, file_tokens=20)
    assert sorted(map(tuple, tokens.read_tokens(spark, folder).collect())) == _expected(t, rows)


def test_op9_added_tokens_that_look_beside_them(tmp_path):
    from tokenizers import AddedToken, Tokenizer

    t = Tokenizer.from_file(_tokenizer()[0])
    t.add_special_tokens([AddedToken("<sep>", lstrip=True, rstrip=True), AddedToken("word", single_word=True)])
    t.save(str(tmp_path / "t.json"))
    t = Tokenizer.from_file(str(tmp_path / "t.json"))
    texts = ["a <sep>  b", "words word", "swordfish", "plain", *SPECIAL]
    flat, counts = tokens.Encoder(str(tmp_path / "t.json")).encode_whole(pa.array(texts))
    expected = [t.encode(x, add_special_tokens=False).ids for x in texts]
    assert counts.tolist() == list(map(len, expected)) and flat.tolist() == sum(expected, [])
