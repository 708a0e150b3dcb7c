"""Secret scan, quotation linking, URL filter and the pipeline."""

import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from factorspark.llm import queries, quotation, secrets, url_filter

KEY = "04dbebab91ab85687d33eeaaf9ac699e1188f962"
TEXTS = [
    (1, f'some words token = "{KEY}" and more'), (2, f"{KEY[:38]}aa bare and 192.168.100.200 and a@mail7.example.com"), (3, None), (4, ""), (5, "plain words only"),
    (6, f'PASSWORD: hunter22xyz, then token = "{KEY[::-1]}" token = "{KEY}"'), (6, "plain words only"), (None, f"secret={KEY}"), (7, "é" * 500 + f" token = '{KEY}' ü"),
    (8, "see https://www.example7.com/en/1234.html or /usr/lib/python3.13/site"), (9, ("lorem ipsum " * 3000) + f'token = "{KEY}"'),
]


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame([(i, t, 1, "v") for i, t in TEXTS], "doc_id long, text string, start int, value string")


def test_candidates_are_at_their_places(texts):
    found = secrets.candidates(texts).collect()
    whole = {i: t for i, t in TEXTS if t != "plain words only"}
    assert all(whole[r["doc_id"]][r["start"]:r["end"]] == r["value"] for r in found)
    assert all(whole[r["doc_id"]][:r["start"]].endswith(r["before"]) and whole[r["doc_id"]][r["end"]:].startswith(r["after"]) for r in found)
    assert {i for i, t in whole.items() if t and KEY in t} <= {r["doc_id"] for r in found if r["value"] == KEY}
    assert secrets.candidates(texts.limit(0)).count() == 0


def scanned(text):
    """Candidates by walking the text: runs of key characters with a digit, and what is assigned to a credential word."""
    key, out, at = set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_+/.-"), [], 0
    assigned = re.compile(rf"(?i)(?:{secrets.CREDENTIAL})[\"']?[ \t]?[:=][ \t]?[\"']?$")
    while at < len(text):
        if assigned.search(text[max(0, at - 60):at]):
            end = at + len(re.match("[^\\s\"']*", text[at:])[0])
            if end - at >= 6:
                out.append((at, end))
                at = end
                continue
        if (at and text[at - 1] in key) or text[at] not in key:
            at += 1
            continue
        end = at
        while end < len(text) and text[end] in key:
            end += 1
        if end - at >= 12 and any(c.isdigit() for c in text[at:end]):
            end += len(text[end:end + 2]) - len(text[end:end + 2].lstrip("="))
            out.append((at, end))
            at = end
        else:
            at += 1
    return out


def test_candidates_are_complete(spark):
    rng = random.Random(21)
    pieces = ["token", "api_key", "Password", "=", ": ", " ", "'", '"', "\n", "/", ".", KEY, "a" * 70 + "1" + "b" * 20, "word", "a1", "9" * 11, "9" * 12, "x" * 200, "=="]
    texts = ["".join(rng.choices(pieces, k=rng.randrange(1, 14))) for _ in range(400)] + ["b" * 20_000 + "7" + "c" * 20_000, "d" * 50_000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {(r["doc_id"], r["start"], r["end"]) for r in secrets.candidates(docs).collect()}
    assert found == {(i, a, b) for i, t in enumerate(texts) for a, b in scanned(t)}


@pytest.fixture(scope="module")
def forest(spark, texts):
    many = [(i, f'word other token = "{i:040x}" end') for i in range(40, 90)] + [(i, f"mail x.{i}@mail{i}.example.com or 10.20.{i}.100 now") for i in range(100, 150)]
    return secrets.trained(secrets.labelled(secrets.candidates(spark.createDataFrame(many, "doc_id long, text string"))), ["word", "other"])


def test_forest_removes_false_positives(texts, forest):
    out = {(r["doc_id"], r["value"]): r["secret"] for r in secrets.judged(secrets.candidates(texts), forest).collect()}
    assert out[1, KEY] and out[6, KEY] and out[6, KEY[::-1]] and out[9, KEY] and out[None, KEY]
    assert not out[2, "mail7.example.com"] and not out[2, "192.168.100.200"]


def test_bare_keys_are_secrets(spark, texts, forest):
    more = spark.createDataFrame([(20, f"the key is {KEY} as agreed"), (21, f"| host | {KEY[::-1]} |"), (22, "mail a@mail7.example.com or call 10.20.30.400 now")], "doc_id long, text string")
    out = {(r["doc_id"], r["value"]): r["secret"] for r in secrets.judged(secrets.candidates(texts.select("doc_id", "text").unionByName(more)), forest).collect()}
    assert out[2, f"{KEY[:38]}aa"] and out[20, KEY] and out[21, KEY[::-1]]
    assert not any(secret for (i, _), secret in out.items() if i == 22) and not out[2, "mail7.example.com"]


def test_redaction(texts, forest):
    rows = secrets.redacted(texts, forest)
    assert rows.columns == texts.columns
    out = [(r["doc_id"], r["text"]) for r in rows.collect()]
    for (i, before), (j, after) in zip(TEXTS, out, strict=True):
        assert i == j
        assert after == (before if before is None else before.replace(KEY, secrets.PLACEHOLDER).replace(KEY[::-1], secrets.PLACEHOLDER)) or i in (2, 6)
    assert secrets.redacted(texts.limit(0), forest).count() == 0


def test_forest_without_both_labels(spark, texts):
    none = spark.createDataFrame([], "value string, before string, after string, label double")
    assert secrets.trained(none).constant == 0.5
    one = spark.createDataFrame([("abc", "", "", 1.0)], none.schema)
    assert secrets.trained(one).constant == 1.0


def test_printed_trees():
    printed = "Forest\n  Tree 0 (weight 1.0):\n    If (feature 3 <= 0.5)\n     If (feature 0 <= 1.0E2)\n      Predict: 0.0\n     Else (feature 0 > 1.0E2)\n      Predict: 1.0\n    Else (feature 3 > 0.5)\n     Predict: 1.0\n  Tree 1 (weight 1.0):\n    Predict: 0.0\n"
    assert secrets.trees_of(printed) == ((3, 0.5, (0, 100.0, 0.0, 1.0), 1.0), 0.0)


URLS = [
    (1, "http://www.Example.com/en/1?x"), (2, "https://a.example.com/en/x"), (3, "https://example.com/de/x"), (4, "http://x.net/es/1"), (5, "http://x.net/de/1?utm_source=a"), (6, "https://www.x.net/de/1/"),
    (7, None), (8, ""), (9, "no scheme"), (10, "http://"), (11, "http://casino.x.org/a"), (11, "http://casino.x.org/a"), (12, "https://m.casino.x.org/a.html#top"), (13, "ftp://org?q=/en/"), (14, "http://a://b/c"),
    (15, "http://notexample.com/en/"), (16, "http://x.org/" + "y" * 50_000), (None, "http://x.net/de/1"), (17, "http://com/"), (18, "http://ÀX.net/fr/É"),
]


def test_urls_equal_the_sql(spark):
    pages = spark.createDataFrame([(i, u, "h", 1) for i, u in URLS], "page_id long, url string, html string, block int")
    out = url_filter.judged(pages, url_filter.listed_of(pages), blocks=2)
    db = duckdb.connect()
    db.sql("CREATE TABLE pages (page_id BIGINT, url VARCHAR)")
    db.executemany("INSERT INTO pages VALUES (?, ?)", URLS)
    want = db.sql(queries.SQL["op10_url_filter"])
    assert sorted(map(str, out.select(*want.columns).toLocalIterator())) == sorted(str(_row(want.columns, r)) for r in want.fetchall())
    by = {r["page_id"]: r for r in out.collect()}
    assert (by[1]["rule"], by[1]["verdict"]) == ("www.example.com/en/", "allow") and by[2]["rule"] == "example.com/en/" and by[15]["rule"] == "com/"
    assert by[4]["verdict"] == "block" and by[6]["listed"] and by[12]["listed"] and by[7]["verdict"] == "allow" and by[7]["host"] == ""
    assert url_filter.judged(pages, spark.createDataFrame([(None,)], "canonical string")).where("listed").count() == 0
    assert url_filter.judged(pages.limit(0), url_filter.listed_of(pages)).count() == 0


def _row(names, values):
    from pyspark.sql import Row

    return Row(**dict(zip(names, values, strict=True)))


def test_bloom_has_no_false_negatives(spark):
    keys = spark.range(3000).select(F.concat(F.lit("k"), "id").alias("canonical"))
    bloom = url_filter.bloom(keys, 64)
    assert bloom.count() <= 64
    assert url_filter.with_possible(keys, bloom, 64).where("not possible").count() == 0
    others = spark.range(3000).select(F.concat(F.lit("q"), "id").alias("canonical"))
    assert url_filter.with_possible(others, url_filter.bloom(keys, 4096), 4096).where("possible").count() < 60


SAID = [
    (1, 0, "user", "How do I sort a table by date?\nThanks in advance"), (1, 1, "assistant", "> How do I sort a table by date?\n\nUse the sort button."),
    (1, 2, "user", "On Monday, A wrote:\n> Use the sort button.\n>> How do I sort a table by date?\nThat does not work."), (1, 3, "other", ">> HOW do I   sort a table by date?\nI have the same question"),
    (1, 4, "assistant", "> nothing that was said before\nHello"), (1, 5, "x", None), (1, 6, "x", ""), (None, 3, None, "> q\nno conversation"), (2, 0, "user", "> That does not work.\nanother conversation"),
    (1, 1, "assistant", "> How do I sort a table by date?\n\nUse the sort button."), (3, None, "user", "no turn"), (4, 0, "user", "a line that is said twice\n" * 40), (4, 1, "user", "a line that is said twice"),
    (4, 2, "user", "> a line that is said twice\nreply"), (4, 3, "user", "> short\n" + "> a line that is said twice\n" * 500 + "long reply"),
    *((5, i, "user", (f"> message number {i - 1} of the chain\n" if i else "") + f"message number {i} of the chain") for i in range(20)),
]


SHORT = [
    (20, 0, "u", "Yes."), (20, 1, "v", "> Yes.\nReally?"), (20, 2, "u", "> Really?\n\nYes, really."),
    (21, 0, "u", "A sentence that was written on one line\nand goes on over another.\n\nNext."), (21, 1, "v", "> A sentence that\n> was written on one line and goes\n> on over another.\nFine"),
    (21, 2, "u", "> > A sentence that was\n> > written on one line and goes on over another.\n> Fine\nok"), (21, 3, "v", ">ok\n>\n> Fine\nboth"),
    (22, 0, "u", "1|2\n3|4"), (22, 1, "v", "> 1|2 3|4\nx"), (22, 2, "v", "> " + "\n> ".join(["word"] * 4000) + "\ny"), (22, 1, "u", "\n".join(["word"] * 2000 + ["word word"] * 1000)),
]


def test_short_and_rewrapped_quotations(spark):
    rows = spark.createDataFrame(SHORT, "conv_id long, turn long, role string, text string")
    found = quotation.conversations(rows)
    db = duckdb.connect()
    db.sql("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    db.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", SHORT)
    want = db.sql(queries.SQL["op8_quotation_linking"])
    assert sorted(map(str, found.select(*want.columns).collect())) == sorted(str(_row(want.columns, r)) for r in want.fetchall())
    parents = {(r["conv_id"], r["turn"]): r["parent_turn"] for r in found.collect()}
    assert [parents[20, i] for i in range(3)] == [None, 0, 1] and [parents[21, i] for i in range(4)] == [None, 0, 1, 2]
    assert parents[22, 1] == 0 and parents[22, 2] == 1


def test_quotations_equal_the_sql(spark):
    rows = spark.createDataFrame([(*r, 1, "x") for r in SAID], "conv_id long, turn long, role string, text string, place int, level string")
    out = quotation.conversations(rows)
    db = duckdb.connect()
    db.sql("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    db.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", SAID)
    want = db.sql(queries.SQL["op8_quotation_linking"])
    found = out.select(*want.columns).collect()
    assert sorted(map(str, found)) == sorted(str(_row(want.columns, r)) for r in want.fetchall())
    by = {(r["conv_id"], r["turn"]): r for r in found}
    assert (by[1, 2]["parent_turn"], by[1, 2]["root_turn"], by[1, 2]["depth"], by[1, 2]["text"]) == (1, 0, 2, "That does not work.")
    assert by[4, 3]["parent_turn"] == 0 and by[5, 19]["depth"] == 19 and by[2, 0]["parent_turn"] is None
    assert quotation.conversations(rows.limit(0)).count() == 0


def test_pipeline(spark, tmp_path):
    words = [f"w{i}" for i in range(60)]
    good = [(i, " ".join(words[(i * 7 + k * 7) % 60] + str(i) for k in range(40)), "en", "s", 0) for i in range(30)]
    rows = [*good, (100, good[3][1], "en", "s", 0), (101, "too short", "en", "s", 0), (102, None, None, None, None), (103, "% % % " * 50, "en", "s", 0), (104, good[5][1] + f' token = "{KEY}"', "en", "s", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(30)] + [(103, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(0, "plain words")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
    ids = {r["doc_id"] for r in docs.collect()}
    assert {101, 102, 103, 100} & ids == set() and {3, 5} <= ids
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert {r["doc_id"] for r in out.collect()} == ids and out.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 2048").count() == 0


def _tables(spark, folder, docs, labels):
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(0, "plain words")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return spark.read.parquet(f"{folder}/documents.parquet")


def test_pipeline_classifier_rejects_what_the_rules_let_pass(spark, tmp_path):
    """Documents like those of label 0 that no rule rejects go; clean ones stay, though no survivor of the rules has label 0."""
    rng = random.Random(4)

    def text(good, n=60):
        return " ".join("".join(rng.choice("abcdefgh" if good else "qxzjkvw") for _ in range(5)) for _ in range(n))

    good = [(i, text(True), "en", "s", 0) for i in range(80)]
    poor = [(200 + i, text(False), "en", "s", 0) for i in range(20)]
    # The labelled ones of label 0 break the rules as well.
    bad = [(400 + i, text(False) + " % # & |" * 80, "en", "s", 0) for i in range(80)]
    docs = _tables(spark, tmp_path, [*good, *poor, *bad], [(r[0], 1, 0) for r in good] + [(r[0], 0, 0) for r in bad])
    passed = corpus_pipeline.quality_rules_stage(spark, docs, str(tmp_path))
    assert {r["doc_id"] for r in passed.collect()} == {r[0] for r in [*good, *poor]}
    kept = {r["doc_id"] for r in corpus_pipeline.quality_classifier_stage(spark, passed, str(tmp_path)).collect()}
    assert len(kept & {r[0] for r in good}) >= 78 and len(kept & {r[0] for r in poor}) <= 2


def test_pipeline_of_odd_tables(spark, tmp_path):
    """Empty tables, labels of one class, repeated and null ids, a very long text and columns whose names the stages use."""
    empty = tmp_path / "empty"
    _tables(spark, empty, [], [])
    assert corpus_pipeline.run(spark, str(empty)).count() == 0
    rng = random.Random(6)
    words = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(3000)]
    long = " ".join(rng.choice(words) for _ in range(60_000))
    rows = [(1, " ".join(words[:50]), "en", "s", 0), (1, " ".join(words[50:100]), "en", "s", 0), (None, " ".join(words[100:150]), None, None, None), (2, long, "en", "s", 0), (3, "", "en", "s", 0)]
    odd = tmp_path / "odd"
    docs = _tables(spark, odd, rows, [(1, 1, 0), (2, 1, 0)])
    with pytest.warns(UserWarning, match="keeps every document"):
        out = corpus_pipeline.run(spark, str(odd)).collect()
    assert {r["doc_id"] for r in out} >= {1, 2, None} and sum(r["length"] for r in out if r["doc_id"] == 2) > 60_000
    wide = docs.withColumns({"row": F.lit(1), "score": F.lit("x"), "parts": F.lit(2), "length": F.lit(3)})
    with pytest.warns(UserWarning):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            wide = stage(spark, wide, str(odd))
            assert set(docs.columns) <= set(wide.columns), name


def test_caches_of_other_operators_end_with_the_next_operators_task():
    from factorspark.llm import common, packing

    path = queries.tokenizer_file("word_bpe_49k.json")
    list(packing.word_ids(path).batch([b"some words"]))
    common.release_others(packing.__name__)
    assert path in packing._TOKENIZERS
    common.release_others("factorspark.llm.byte_cnn")
    assert not packing._TOKENIZERS
