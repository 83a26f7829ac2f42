"""Decontamination, exact dedup, mixing, surrogates, WARC and the pipeline."""

import collections
import gzip
import hashlib
import math
import random
import re

import pytest
from brute import before, fold, jaccard, table
from conftest import AWKWARD
from pyspark.sql import functions as F

from halyard.llm import cluster, decontaminate, exact_dedup, mixing, queries, surrogates, warc

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
ASCII_LOWER = {i: i + 32 for i in range(65, 91)}


# ---------------------------------------------------------------- decontamination


def contaminated(docs, items, size=10):
    """(id, words, hit words, sorted item ids) by comparing every window."""
    words = lambda t: WORD.findall((t or "").translate(ASCII_LOWER))
    windows = collections.defaultdict(set)
    for i, t in items:
        w = words(t)
        for p in range(max(1, len(w) - size + 1) if w else 0):
            windows[tuple(w[p : p + size])].add(i)
    out = []
    for i, t in docs:
        w, hit, found = words(t), set(), set()
        for n in {len(k) for k in windows}:
            for p in range(len(w) - n + 1):
                if tuple(w[p : p + n]) in windows:
                    hit.update(range(p, p + n))
                    found |= windows[tuple(w[p : p + n])]
        out.append((i, len(w), len(hit), sorted(str(x) for x in found if x is not None)))
    return out


ITEMS = [(1, "one two THREE four five six seven eight nine ten eleven"), (2, "été à"), (3, None), (4, " ?! "), (None, "single"), (10, "the the the the the the the the the the"), (11, "w5 x5 w6 x6 w7 x7 w8 x8 w9 x9 w10 x10"), (12, "İstanbul Kelvin K"), (2, "one two three four five six seven eight nine ten")]
EXTRA = [(20, "visit İstanbul, kelvin K now"), (21, "visit istanbul kelvin k"), (22, "İSTANBUL KELVIN K"), (23, "ten one two three four five six seven eight nine ten one")]


@pytest.mark.parametrize("block_rows", [decontaminate.BLOCK_ROWS, 7])
def test_op4_awkward(spark, awkward, block_rows):
    docs = awkward.unionByName(spark.createDataFrame(EXTRA, "doc_id long, text string"), allowMissingColumns=True)
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = decontaminate.contamination(docs, items, block_rows=block_rows).collect()
    assert table((r.id, r.n_words, r.n_hit, list(r["items"])) for r in got) == table(contaminated(AWKWARD + EXTRA, ITEMS))


def test_op4_empty(spark, awkward, nothing):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert decontaminate.contamination(nothing, items).count() == 0
    clean = decontaminate.contamination(awkward, items.where("false")).collect()
    assert len(clean) == len(AWKWARD) and all(r.n_hit == 0 and not r["items"] for r in clean)


GREEK = [(1, "Α.Σ. x"), (2, "ΟΔΟΣ.Α"), (3, "ΟΔΟΣ Β"), (4, "ο κ. Α.Σ. Παπάς, ΟΔΟΣ:Α' ΣΟΦΟΣ^Γ, δύο τρία τέσσερα"), (5, "ΟΔΟΣ' 5"), (6, "οδος α")]
GREEK_DOCS = [(1, "see Α.Σ. x here"), (2, "Α Σ x"), (3, "στην ΟΔΟΣ.Α και ΟΔΟΣ.Β"), (4, "ΟΔΟΣ Α"), (5, "πριν ο κ. Α.Σ. Παπάς, ΟΔΟΣ:Α' ΣΟΦΟΣ^Γ, δύο τρία τέσσερα μετά"), (6, "οδοσ α οδος α"), (7, "ΟΔΟΣ' 5 Α`Σ`X")]


def test_op4_capital_sigma_beside_separators(spark):
    docs, items = spark.createDataFrame(GREEK_DOCS, "doc_id long, text string"), spark.createDataFrame(GREEK, "item_id long, text string")
    got = decontaminate.contamination(docs, items).collect()
    expected = contaminated(GREEK_DOCS, GREEK)
    assert all(n for _, _, n, _ in expected)
    assert table((r.id, r.n_words, r.n_hit, list(r["items"])) for r in got) == table(expected)


def test_op4_runs_no_python_on_executors(spark, sf_dir):
    for q in (queries.op4_decontamination, queries.op5_pii_surrogates, queries.op6_exact_dedup):
        plan = q(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Pandas|InArrow", plan)


def test_op4_query(spark, sf_dir):
    read = lambda n: [tuple(r) for r in spark.read.parquet(f"{sf_dir}/{n}.parquet").select(f"{'doc' if n == 'documents' else 'item'}_id", "text").collect()]
    got = queries.op4_decontamination(spark, sf_dir).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect()
    expected = contaminated(read("documents"), read("benchmark"))
    assert table(got) == table((i, n, h, len(x), hashlib.sha256(",".join(x).encode()).hexdigest(), h > 0) for i, n, h, x in expected)
    assert sum(r.contaminated for r in got) > 0


# ---------------------------------------------------------------- exact dedup


def equal_texts(rows):
    groups = collections.defaultdict(list)
    norm = [re.sub(r"[\x20\x09-\x0D]+", "", t or "") for _, t in rows]
    for (i, t), n in zip(rows, norm):
        groups[n].append((-len(t or ""), i is None, i or 0, i))
    return [(i, min(groups[n])[3], len(groups[n]), i == min(groups[n])[3], hashlib.sha256(n.encode()).hexdigest()) for (i, _), n in zip(rows, norm)]


def test_op6_awkward(awkward, nothing):
    got = exact_dedup.exact_duplicates(awkward, digests=True).select("id", "keep_id", "group_size", "kept", "text_sha256").collect()
    assert table(got) == table(equal_texts(AWKWARD))
    again = exact_dedup.exact_duplicates(awkward).collect()
    assert table(again) == table(r[:4] for r in equal_texts(AWKWARD))
    assert exact_dedup.exact_duplicates(nothing, digests=True).count() == 0
    assert exact_dedup.exact_duplicates(nothing).count() == 0


def test_op6_more_classes_than_are_broadcast(awkward, monkeypatch):
    monkeypatch.setattr(exact_dedup, "BROADCAST_CLASSES", 0)
    again = exact_dedup.exact_duplicates(awkward).collect()
    assert table(again) == table(r[:4] for r in equal_texts(AWKWARD))


def test_op6_reads_in_full_only_what_has_company(spark):
    rows = [(1, "same"), (2, "sa me"), (3, "other text"), (4, "x" * 70 + "1"), (5, "x" * 70 + "2")]
    left = exact_dedup.company(spark.createDataFrame(rows, "doc_id long, text string"), "text").collect()
    assert sorted(r.n_bytes for r in left) == [4, 71]


def test_op6_same_length_and_beginning_differ(spark):
    rows = [(1, "a" * 100 + "x"), (2, "a" * 100 + "y"), (3, "a" * 100 + " x"), (4, "b" * 101)]
    got = exact_dedup.exact_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.id: r.keep_id for r in got} == {1: 3, 2: 2, 3: 3, 4: 4}


# ---------------------------------------------------------------- mixing


def test_op7_awkward(spark, awkward, nothing):
    got = mixing.poisson_mix(awkward, total=3.0)
    assert got.columns == [c for c in awkward.columns if c != "copy"] + ["n_copies", "copy", "shuffle_key"]
    rows = got.collect()
    per = collections.Counter((r.chunk, r.n_copies) for r in rows)
    assert all(count == n for (_, n), count in per.items())
    assert mixing.poisson_mix(nothing).count() == 0
    assert [r.shuffle_key for r in rows] == sorted(r.shuffle_key for r in rows)


def test_op7_inverts_the_poisson_distribution(spark):
    n, rate = 20_000, 1.7
    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.lit("s").alias("source"))
    counts = collections.Counter(r.n_copies for r in mixing.poisson_mix(docs, total=rate).where("copy = 1").collect())
    counts[0] = n - sum(counts.values())
    for k in range(7):
        p = math.exp(-rate) * rate**k / math.factorial(k)
        assert abs(counts[k] - n * p) < 5 * math.sqrt(n * p * (1 - p)) + 1


def test_op7_reaches_given_targets(spark):
    docs = spark.range(30_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 10 == 0, "rare").when(F.col("id") % 10 == 1, F.lit(None)).otherwise("hot").alias("source"))
    got = {r[0]: r[1] for r in mixing.poisson_mix(docs, targets={"rare": 1.0, "hot": 3.0}, total=2.0).groupBy("source").count().collect()}
    assert set(got) == {"rare", "hot"}
    assert abs(got["rare"] - 15_000) < 700 and abs(got["hot"] - 45_000) < 1_100


def test_op7_large_rates(spark):
    docs = spark.range(40).select(F.col("id").alias("doc_id"), F.lit("s").alias("source"))
    assert abs(mixing.poisson_mix(docs, total=900.0).count() - 36_000) < 1_200


def test_op7_very_large_rates(spark):
    """Drawn in pieces: a hundred thousand copies of one document, within five standard deviations."""
    docs = spark.createDataFrame([(1, "s"), (2, "s")], "doc_id long, source string")
    counts = [r.n_copies for r in mixing.poisson_mix(docs, total=100_000.0).where("copy = 1").collect()]
    assert len(counts) == 2 and all(abs(n - 100_000) < 5 * math.sqrt(100_000) for n in counts) and counts[0] != counts[1]


# ---------------------------------------------------------------- surrogates

PRIVATE = (
    "Call Mr. John Smith at +1 (488) 555-2303 or 488-555-2303. Mrs Anna Lee, Г-жа Мария Петрова; SSN 123-45-6789, card 4111-1111-1111-1111 and 4111111111111111. "
    "jo.81@mail7.example.com JO.81@MAIL7.EXAMPLE.COM 10.0.0.1 token = \"34cf1be9225426587b06121cb35ab512e5a1beb5\""
)


def test_op5_formats_and_coreference(spark):
    docs = spark.createDataFrame([(1, PRIVATE), (2, "again jo.81@mail7.example.com, 10.0.0.1"), (3, "no data at all"), (4, None)], "doc_id long, text string")
    rows = {r.doc_id: r for r in surrogates.replace_personal_data(docs).collect()}
    new = rows[1].clean_text
    for secret in ("Smith", "Anna", "Мария", "555-2303", "123-45-6789", "4111", "jo.81", "10.0.0.1 ", "34cf1be9"):
        assert secret not in new
    first, second = re.search(r"\+1 \((\d{3})\) (\d{3}-\d{4}) or (\S+)\.", new).group(1, 2), re.search(r" or (\S+)\. ", new)[1]
    assert second == "-".join(first)
    cards = re.search(r"card (\d{4}-\d{4}-\d{4}-\d{4}) and (\d{16})\.", new)
    assert cards[1].replace("-", "") == cards[2]
    mail = re.search(r"([a-z]{2}\.\d\d@[a-z]{4}\d\.[a-z]{7}\.[a-z]{3}) ([A-Z]{2}\.\d\d@\S+)", new)
    assert mail[2] == mail[1].upper() and mail[1] in rows[2].clean_text
    assert re.search(r'token = "[0-9a-f]{40}"$', new) and re.search(r"SSN \d{3}-\d{2}-\d{4},", new)
    assert re.search(r"Mr\. [A-Z]\w+ [A-Z]\w+ at", new)[0].split()[1] in surrogates._LATIN_M
    assert re.search(r"Mrs (\w+)", new)[1] in surrogates._LATIN_F and re.search(r"Г-жа (\w+) \w+ова;", new)[1] in surrogates._CYRILLIC_F
    assert (rows[3].clean_text, rows[3].n_entities) == ("no data at all", 0) and rows[4].clean_text is None and rows[4].n_entities == 0


def test_op5_clashes_are_drawn_again(spark, monkeypatch):
    """With one-letter names almost all first draws coincide; the results must be distinct."""
    monkeypatch.setattr(surrogates, "_LATIN_START", ["Bar"])
    monkeypatch.setattr(surrogates, "_LATIN_MORE", ["ber", "den"])
    rows = [(i, f"Mr Q{'abcdefghij'[i]}x came. Mr Q{'abcdefghij'[i]}x left.") for i in range(10)] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    again = surrogates.draws(docs, "text")
    assert again.count() > 0
    got = surrogates.replace_personal_data(docs).collect()
    names = collections.defaultdict(set)
    for r in got:
        a, b = re.findall(r"Mr (\w+)", r.clean_text)
        assert a == b
        names[r.doc_id].add(a)
    assert all(len(x) == 1 for x in names.values()) and len({y for x in names.values() for y in x}) == 10


def test_op5_awkward(awkward, nothing):
    got = surrogates.replace_personal_data(awkward).collect()
    assert table((r.doc_id, r.clean_text) for r in got) == table(AWKWARD)
    assert surrogates.replace_personal_data(nothing).count() == 0


def test_op5_query_changes_only_entities(spark, sf_dir):
    old = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    any_digit = re.compile(r"\S*[0-9@]\S*")
    for r in queries.op5_pii_surrogates(spark, sf_dir).collect():
        assert (r.n_entities > 0) == r.has_pii
        if not r.has_pii:
            assert r.text == old[r.doc_id]
        else:
            assert r.text != old[r.doc_id] and len(r.text.split()) == len(old[r.doc_id].split())
            assert not set(re.findall(r"[\w.]+@[\w.]+", old[r.doc_id])) & set(re.findall(r"[\w.]+@[\w.]+", r.text))
            assert any_digit.sub("#", r.text) == any_digit.sub("#", old[r.doc_id])


# ---------------------------------------------------------------- WARC

PAGES = [(3, "http://a/", "x" * 150), (1, "http://b/ c\r\n", "x" * 150), (2, None, "x" * 99), (4, "u", "x" * 99), (5, "u", None), (6, "u", ""), (None, "u", "x" * 150), (7, "ü", "é€" * 60), (1, "again", "x" * 150), (8, "u", "WARC/1.1\r\n\x1f\x8b\x08 inside\r\n\r\n" * 20)]


def test_op8_round_trip(spark):
    pages = spark.createDataFrame([(*p, "c", 1) for p in PAGES], "page_id long, url string, html string, payload string, id int")
    path = cluster.shared_dir(spark)
    warc.write_warc(pages, path, archive_bytes=600)
    rows = warc.read_warc(spark, path).collect()
    assert {r.kind for r in rows} == {"record"} and len(rows) == len(PAGES)
    by = collections.defaultdict(list)
    for r in rows:
        by[r.page_id].append(r)
    for page, _, html in PAGES:
        data = (html or "").encode()
        first = min((i for i, _, h in PAGES if h == html and i is not None), default=None)
        for r in by[page]:
            assert (r.payload_bytes, r.payload_digest) == (len(data), hashlib.sha256(data).hexdigest())
            if len(data) >= 100 and page != first:
                assert (r.record_type, r.refers_to) == ("revisit", first)
            else:
                assert (r.record_type, r.refers_to, bytes(r.payload)) == ("response", None, data)
    path = cluster.shared_dir(spark)
    warc.write_warc(pages.where("false"), path)
    assert warc.read_warc(spark, path).count() == 0


def _records(n):
    return [warc.record(i, f"http://x/{i}", f"page {i} ".encode() * 30, hashlib.sha256(f"page {i} ".encode() * 30).hexdigest(), len(f"page {i} ".encode() * 30), None) for i in range(n)]


def _ids(found):
    """Page numbers; a plain header has no checksum, so a damaged digit can slip through."""
    return [int(m[1]) for r in found if (m := re.search(r"page:(\d+)", r.fields["warc-record-id"]))]


@pytest.mark.parametrize("packed", [True, False])
def test_op8_salvage_after_damage(packed):
    parts = [warc.member(r) if packed else r for r in _records(12)]
    whole = b"".join(parts)
    found, gaps = warc.salvage(whole + b"\0" * 4 * packed)
    assert _ids(found) == list(range(12)) and not gaps
    start = [sum(map(len, parts[:i])) for i in range(13)]
    draw = random.Random(3)
    for _ in range(30):
        broken = bytearray(whole)
        hit = sorted(draw.sample(range(12), 3))
        for i in hit:
            at = draw.randrange(start[i] + (12 if packed else 0), start[i + 1] - 5)
            broken[at] ^= 0x55
        found, gaps = warc.salvage(bytes(broken))
        ids = _ids(found)
        assert set(range(12)) - set(hit) <= set(ids)
        lost = set(range(12)) - set(ids)
        for i in lost:
            assert any(a <= start[i] < b for a, b, _ in gaps)
        for r in found:
            assert any(a == r.offset for a in start)
        assert all(why for *_, why in gaps)


def test_op8_salvage_of_cut_and_joined_archives():
    parts = [warc.member(r) for r in _records(5)]
    whole = b"".join(parts)
    found, gaps = warc.salvage(whole[: -len(parts[-1]) // 2])
    assert _ids(found) == [0, 1, 2, 3] and gaps[-1][1] == len(whole) - len(parts[-1]) + (len(parts[-1]) - -(-len(parts[-1]) // 2))
    found, gaps = warc.salvage(b"junk" + parts[0] + b"noise" + _records(2)[1] + parts[2][:40] + parts[3])
    assert _ids(found) == [0, 1, 3] and len(gaps) == 3
    assert warc.salvage(b"") == ([], []) and warc.salvage(b"\0\0") == ([], [])
    found, gaps = warc.salvage(gzip.compress(b"".join(_records(3))))
    assert _ids(found) == [0, 1, 2] and not gaps
    assert warc.salvage(b"nothing here")[1] == [(0, 12, "no version line")]


def test_op8_long_headers(spark):
    """A header may be longer than 64 KB; none of its pages is missing from the result."""
    urls = ["data:text/html," + "x" * 100_000, "http://a/" + "é /" * 60_000, "u"]
    pages = spark.createDataFrame([(i, u, f"page {i % 2} " * 30) for i, u in enumerate(urls)], "page_id long, url string, html string")
    path = cluster.shared_dir(spark)
    warc.write_warc(pages, path)
    rows = {r.page_id: r for r in warc.read_warc(spark, path).collect()}
    assert {r.kind for r in rows.values()} == {"record"} and sorted(rows) == [0, 1, 2]
    assert [rows[i].uri for i in range(3)] == [u.replace(" ", "%20") for u in urls] and rows[2].refers_to == 0
    plain = warc.record(7, urls[0], b"y", hashlib.sha256(b"y").hexdigest(), 1, None)
    cut = plain.replace(b"\r\n\r\n", b"\r\n").rstrip(b"\r\n")
    found, gaps = warc.salvage(cut + b"\r\n" + plain + cut)
    assert _ids(found) == [7] and [(a, b) for a, b, _ in gaps] == [(0, len(cut) + 2), (len(cut) + 2 + len(plain), 2 * len(cut) + 2 + len(plain))]


def test_op8_query(spark, sf_dir):
    pages = {r.page_id: (r.html or "").encode() for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    rows = queries.op8_warc(spark, sf_dir).collect()
    assert len(rows) == len(pages)
    for r in rows:
        assert (r.payload_bytes, r.payload_digest) == (len(pages[r.page_id]), hashlib.sha256(pages[r.page_id]).hexdigest())


# ---------------------------------------------------------------- pipeline


def test_pipeline_against_plain_stages(spark, sf_dir):
    """Stage by stage on the small tables: what goes is what the contracts say, clean documents stay."""
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
    assert [k for k, _ in corpus_pipeline.STAGES] == ["language_id", "ngram_jaccard_join", "decontamination", "mixing", "token_ids"]
    stage = dict(corpus_pipeline.STAGES)
    kept = cluster.saved(stage["language_id"](spark, docs, sf_dir))
    assert kept.columns == docs.columns
    texts = {r.doc_id: r.text for r in docs.collect()}
    ids = {r.doc_id for r in kept.collect()}
    assert all(not any(map(str.isalpha, texts[i] or "")) for i in set(texts) - ids)
    near = cluster.saved(stage["ngram_jaccard_join"](spark, kept, sf_dir))
    expected = {i for i, _, c in jaccard([(i, texts[i]) for i in sorted(ids)]) if i == c}
    assert {r.doc_id for r in near.collect()} == expected and near.columns == docs.columns
    clean = cluster.saved(stage["decontamination"](spark, near, sf_dir))
    expected = {i for i, _, h, _ in contaminated([(i, texts[i]) for i in sorted(expected)], items) if not h}
    assert {r.doc_id for r in clean.collect()} == expected and clean.columns == docs.columns
    mixed = cluster.saved(stage["mixing"](spark, clean, sf_dir))
    assert mixed.columns == docs.columns and {r.doc_id for r in mixed.collect()} <= expected
    out = stage["token_ids"](spark, mixed, sf_dir).collect()
    assert len(out) == mixed.count() and [r.start for r in sorted(out, key=lambda r: r.start)][0] == 0
    assert len(corpus_pipeline.run(spark, sf_dir).collect()) == len(out)


def test_language_stage_drops_unlearned_languages_and_random_letters(spark, sf_dir):
    import corpus_pipeline

    draw = random.Random(5)
    finnish = "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto, ja heidän on toimittava toisiaan kohtaan veljeyden hengessä. Jokainen on oikeutettu kaikkiin tässä julistuksessa esitettyihin oikeuksiin ja vapauksiin."
    polish = "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem i powinni postępować wobec innych w duchu braterstwa. Każdy człowiek posiada wszystkie prawa i wolności zawarte w niniejszej Deklaracji."
    letters = "".join(draw.choices("abcdefghijklmnopqrstuvwxyz", k=600))
    words = " ".join("".join(draw.choices("abcdefghijklmnopqrstuvwxyz", k=draw.randint(2, 9))) for _ in range(150))
    coded = "".join(draw.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", k=800))
    english = "All human beings are born free and equal in dignity and rights. They are endowed with reason and conscience and should act towards one another in a spirit of brotherhood. Everyone is entitled to all the rights and freedoms set forth in this Declaration, without distinction."
    asked = [(-i, t) for i, t in enumerate([finnish, polish, letters, words, coded, english, letters[:150]], 1)]
    # without a label, so nothing is learned from them
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    docs = docs.unionByName(spark.createDataFrame(asked, "doc_id long, text string"), allowMissingColumns=True)
    kept = corpus_pipeline.language(spark, docs, sf_dir).where("doc_id < 0").collect()
    assert sorted(r.doc_id for r in kept) == [-7, -6]


def test_stages_awkward(spark, awkward, nothing, sf_dir):
    import corpus_pipeline

    docs = awkward.withColumn("said_lang", F.lit("kept"))
    for docs in (docs, docs.where("false")):
        left = docs
        for name, stage in corpus_pipeline.STAGES[:-1]:
            left = cluster.saved(stage(spark, left, sf_dir))
            assert left.columns == docs.columns, name
            assert left.where("said_lang <> 'kept' or chunk < 0").count() == 0
        assert corpus_pipeline.STAGES[-1][1](spark, left, sf_dir).count() == left.count()


def test_folds_use_crc32(spark):
    rows = spark.createDataFrame([(0,), (17,), (None,)], "doc_id long").select("doc_id", queries.fold("doc_id", 4).alias("f")).collect()
    assert all(r.f == fold(r.doc_id, 4) for r in rows)


def test_before_orders_nulls_last():
    assert before(1, 2) and before(1, None) and not before(None, None) and not before(None, 1)
