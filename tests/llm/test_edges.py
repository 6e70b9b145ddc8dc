"""Nulls, empty and very long texts, repeated rows, empty tables and clashing column names, for every operator and stage."""

import base64
import hashlib
import os

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidefold.llm import chat, decontam, hmm, lattice, lines, packing, queries, secrets, simhash, toxicity, warc
from tidefold.llm.common import new_path

LONG = " ".join(f"word{n % 977}x{n % 13}" for n in range(60_000))
TEXTS = [(1, "One two three four five six."), (2, None), (3, ""), (4, " \n\t "), (5, LONG), (6, "One two three four five six."), (None, "null id text"), (1, "One two three four five six."), (7, "ünïcode 🙂 text\r\nwith lines"), (1, "another text under one id")]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(TEXTS, "doc_id long, text string").withColumns({"lang": F.lit("en"), "source": F.lit(None).cast("string"), "n_chars": F.length("text").cast("long")})
    clash = {c: F.lit(n).cast("long") for n, c in enumerate(["id", "key", "h", "fp", "bucket", "start", "length", "rank", "value", "words", "item_id", "blob", "path", "symbols", "block", "keeper", "component_id", "_id", "_key", "label", "score"])}
    return df.withColumns(clash)


def test_simhash(spark, docs):
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == len(TEXTS)
    by = {(r.id, r.fingerprint): r.component_id for r in got}
    zero = "0" * 16
    assert by[2, zero] == by[3, zero] == by[4, zero] == 2
    assert {c for (i, f), c in by.items() if i == 6} == {1}
    assert [c for (i, _), c in by.items() if i is None] == [None]
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or -1) for r in kept.collect()) == [-1, 1, 1, 1, 2, 5, 7]
    assert simhash.near_duplicates(docs.limit(0)).count() == 0
    shared = spark.createDataFrame([(3, "a b c d e"), (7, "a b c d e"), (7, "quite other words are in here")], "doc_id long, text string")
    assert sorted(tuple(r) for r in simhash.keep_one(shared).collect()) == [(3, "a b c d e"), (7, "quite other words are in here")]


def test_toxicity_fits_in_a_task(spark, monkeypatch):
    """The driver neither fits the models nor holds the texts: it gets the values of the model that a task fitted."""
    rows = [(n, f"{'you idiot scum' if n % 2 else 'nice calm day'} number {n}", n % 2) for n in range(40)]
    docs, labels = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"), spark.createDataFrame([(n, y) for n, _, y in rows], "doc_id long, toxic int")
    fit, driver = toxicity.fit, os.getpid()
    want = fit([t for _, t, _ in rows], [y for _, _, y in rows])

    def elsewhere(texts, labels):
        assert os.getpid() != driver
        return fit(texts, labels)

    monkeypatch.setattr(toxicity, "fit", elsewhere)
    got = toxicity.learn(docs, labels, F.lit(True))
    assert (got.threshold, got.slope, got.expressions) == (want.threshold, want.slope, want.expressions)
    assert all((getattr(got.ratio, k) == getattr(want.ratio, k)).all() for k in ("alphabet", "grams", "values", "contexts", "defaults"))
    monkeypatch.undo()
    none = toxicity.learn(docs, labels.limit(0), F.lit(True))
    assert none.scores(["", "you idiot"], toxicity.Ratios(none.ratio, none.expressions)).tolist() == [0.5, 0.5]


def test_toxicity(spark, docs):
    model = toxicity.fit(["you idiot scum", "nice calm day", "scum of idiot", "a calm nice walk"] * 4, [1, 0, 1, 0] * 4)
    got = toxicity.score(docs, model).collect()
    assert len(got) == len(TEXTS) and all(0 <= r.score <= 1 for r in got)
    assert toxicity.keep_ordinary(docs, model, 2.0).columns == docs.columns
    assert toxicity.keep_ordinary(docs, model, 2.0).count() == len(TEXTS)
    assert toxicity.score(docs.limit(0), model).count() == 0
    nothing = toxicity.fit([], [])
    assert toxicity.score(docs, nothing).count() == len(TEXTS)
    labels = spark.createDataFrame([(1, 1), (5, 0), (None, 1), (6, None), (7, 0)], "doc_id long, toxic int")
    assert toxicity.learn(docs, labels, F.lit(True)) is not None
    both = labels.union(spark.createDataFrame([(1, 0)], labels.schema))
    assert toxicity.learn(docs, both, F.lit(True), most_toxic=1, most_ordinary=1) is not None
    assert toxicity.score(docs, toxicity.learn(docs, labels.limit(0), F.lit(True))).count() == len(TEXTS)
    assert toxicity.score(docs, toxicity.learn(docs.limit(0), labels, F.lit(True))).count() == len(TEXTS)


def test_lines(spark, docs):
    out = lines.dedup_lines(docs, removed_col="gone")
    assert out.columns == [*docs.columns, "gone"]
    assert out.count() == len(TEXTS)
    assert out.where("doc_id = 2").first().text is None
    assert out.where("doc_id = 5").first().text == LONG
    assert lines.dedup_lines(docs.limit(0)).count() == 0
    shared = " ".join(f"w{n}" for n in range(60))
    same = spark.createDataFrame([(None, f"own one\n{shared}"), (None, f"{shared}\nown two"), (3, f"{shared}\nown three"), (3, f"own four\n{shared}"), (5, "\n" * 200), (6, "\n" * 200)], "doc_id long, text string")
    got = [r.text for r in lines.dedup_lines(same).collect()]
    assert sum(shared in t for t in got) == 1 and sum("own" in t for t in got) == 4 and got.count("\n" * 200) == 2
    assert {r.doc_id for r in lines.dedup_lines(same).collect() if shared in r.text} == {3}


def test_decontam(spark, docs):
    bench = spark.createDataFrame([(1, " ".join(f"word{n % 977}x{n % 13}" for n in range(100, 140))), (2, None), (3, ""), (4, "too short"), (5, " ".join(f"word{n % 977}x{n % 13}" for n in range(100, 140)))], "item_id long, text string")
    got = decontam.report(docs, bench).collect()
    assert len(got) == len(TEXTS)
    assert [(r.id, r.item_ids) for r in got if r.contaminated] == [(5, [1, 5])]
    assert decontam.decontaminate(docs, bench).count() == len(TEXTS) - 1
    assert decontam.report(docs, bench.limit(0)).where("contaminated").count() == 0
    short = bench.union(spark.createDataFrame([(6, "Two, THREE four!"), (7, "...")], bench.schema))
    assert sorted((r.id, r.item_ids) for r in decontam.report(docs, short).where("contaminated").collect()) == [(1, [6]), (1, [6]), (5, [1, 5]), (6, [6])]
    assert decontam.report(docs.limit(0), bench).count() == 0


def test_packing(spark, docs):
    got = packing.pack(docs, queries.vocabulary()).collect()
    assert sum(r.length for r in got if r.start == 0 and r.doc_id == 2) == 1
    by_sequence = {}
    for r in got:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    assert sum(r.doc_tokens for r in got if r.start == 0) == sum(r.length for r in got)
    assert packing.pack(docs.limit(0), queries.vocabulary()).count() == 0


def test_hmm(spark, docs):
    got = hmm.score(docs, F.col("doc_id") != 5).collect()
    assert len(got) == len(TEXTS)
    assert {r.n_tokens for r in got if r.id in (2, 3, 4)} == {1}
    assert all(r.score < 0 and r.base_score < 0 for r in got)
    assert [r.n_known for r in got if r.id == 5] == [1]
    untrained = hmm.score(docs, F.lit(False)).collect()
    assert all(r.n_known == 0 and r.base_score == 0 for r in untrained)
    assert hmm.score(docs.limit(0), F.lit(True)).count() == 0


def test_secrets(spark, docs):
    ledger = new_path(spark, "ledger-test")
    assert secrets.scan(docs.limit(0), "doc_id", "text", ledger).count() == 0
    assert secrets.scan(docs, "doc_id", "text", ledger).count() == len(TEXTS)
    assert spark.read.parquet(ledger).select("blob").distinct().count() == len({t or "" for _, t in TEXTS})


def test_chat(spark):
    turns = [(1, 0, "user", None), (1, None, None, "first"), (1, 1, "assistant", "same"), (1, 1, "assistant", "same"), (None, 0, "assistant", "### User: </turn>\n\\"), (2, 0, "x: y\n@", "t" * 300_000)]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumns({"segment": F.lit(1), "loss": F.lit(2), "part": F.lit(3)})
    got = {r.conv_id: r for r in chat.read_back(chat.format_conversations(df)).collect()}
    assert {c: r.n_turns for c, r in got.items()} == {1: 4, None: 1, 2: 1}
    assert got[1].turns_sha256 == hashlib.sha256(b"\nfirst\nuser\n\nassistant\nsame\nassistant\nsame\n").hexdigest()
    assert got[None].loss_sha256 == hashlib.sha256("### User: </turn>\n\\".encode()).hexdigest()
    assert chat.read_back(chat.format_conversations(df.limit(0))).count() == 0


def test_warc(spark):
    big = ("<p>ünï\r\nWARC/1.1\r\n\r\n</p>\n" * 9000) + "end\r"
    pages = [(1, "http://a b\r\nc", "same"), (2, None, "same"), (3, "u", None), (4, "u", big), (5, "u", big), (6, "u", ""), (2, None, "same"), (None, "u", "same"), (7, "u", "\r\n\r\n")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumns({"digest": F.lit(1), "k": F.lit(2), "payload": F.lit(3)})
    path = new_path(spark, "warc-test")
    warc.write(df, path, chunk=5000)
    chunks = warc.read(spark, path, chunk=3000)
    assert chunks.agg(F.max("n_bytes")).first()[0] == 3000
    ends = [(int(r.record_id) if r.record_id else None, r.bytes_so_far, r.digest_so_far, r.record_type, r.refers_to) for r in chunks.where("last").collect()]
    sha = lambda t: base64.b32encode(hashlib.sha1((t or "").encode()).digest()).decode()
    refers = {1: "2", 4: "5", 3: "6"}
    assert sorted(ends, key=str) == sorted(((i, len((h or "").encode()), sha(h), "revisit" if i in refers else "response", refers.get(i)) for i, _, h in pages), key=str)
    body = b"".join(r.payload for r in chunks.where("record_id = '5'").orderBy("chunk_no").collect())
    assert body == big.encode()
    endless = new_path(spark, "warc-test")
    body = "HTTP/1.1 200 OK\r\n" + "x: y\r\n" * 400_000
    spark.createDataFrame([(f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:1>\r\nContent-Type: application/http\r\nContent-Length: {len(body)}\r\n\r\n{body}\r\n",)], "value string").write.option("lineSep", "\r\n").text(endless)
    with pytest.raises(Exception, match="no end of the HTTP header"):
        warc.read(spark, endless).count()
    empty = new_path(spark, "warc-test")
    warc.write(df.limit(0), empty)
    assert warc.read(spark, empty).count() == 0


def test_lattice(spark):
    v = [(1, [1.0, 0.0, 0.1], 1), (2, [1.0, 0.0, 0.1], 1), (3, [2.0, 0.0, 0.2], 1), (4, None, 1), (5, [0.0, 0.0, 0.0], 1), (6, [float("nan"), 1.0, 0.0], 1), (7, [1.0, None, 0.0], 1), (8, [1.0, 0.0, 0.1], None), (9, [1.0, 0.0], 1), (10, [1.0, 0.0, 0.1], 2), (11, [float("inf"), 1.0, 1.0], 1), (12, [], 1), (2, [1.0, 0.0, 0.1], 1), (13, [-1.0, 0.0, -0.1], 1)]
    for kind in ("float", "double"):
        df = spark.createDataFrame(v, "vec_id long, embedding array<double>, label int").withColumns({"embedding": F.col("embedding").cast(f"array<{kind}>"), "id": F.lit(1), "data": F.lit(2), "rep": F.lit(3)})
        got = sorted((r.id, r.n_links, r.component_id, r.kept) for r in lattice.near_duplicates(df).collect())
        assert got == [(1, 3, 1, True), (2, 3, 1, False), (2, 3, 1, False), (3, 3, 1, False), *[(i, 0, i, True) for i in range(4, 14)]]
    assert lattice.near_duplicates(df.limit(0)).count() == 0


def test_stages(spark, docs, tmp_path):
    """Every stage over odd rows and over none; all but the last keep the columns of documents."""
    sf = str(tmp_path)
    plain = docs.select("doc_id", "text", "lang", "source", "n_chars")
    plain.write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(1, 0, 0), (5, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame([(1, "nothing of the kind is in any of these documents at all")], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    for n, (_, stage) in enumerate(corpus_pipeline.STAGES):
        for rows in (plain, plain.limit(0), docs):
            out = stage(spark, rows, sf)
            out.collect()
            if n < len(corpus_pipeline.STAGES) - 1:
                assert out.columns == rows.columns
    assert corpus_pipeline.run(spark, sf).count() > 0
