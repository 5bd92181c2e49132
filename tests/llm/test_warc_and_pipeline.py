"""Operator 9 as an exact round trip, and the pipeline against brute force."""

import hashlib
import io

import duckdb
import pytest
import zstandard

import corpus_pipeline
from catalith.llm import exact_dedup, quality, toxicity, warc
from catalith.llm.common import release, written
from catalith.llm.queries import QUERIES, SQL
from tests.conftest import SF
from tests.llm.helpers import awkward, empty, prose, save
from tests.llm.test_dedup import plain_similar


def pages(spark):
    big = "<p>" + prose(40, 1) + "</p>"
    rows = [(5, "http://a/1", big), (3, "http://a/\r\n2", big), (9, None, big), (None, "x", big), (1, "http://b", "short"), (2, "http://b", "short"), (4, None, None), (6, "u", ""), (7, "u", "é" * 60), (8, "u", "é" * 60), (10, "u", "\r\n\r\nWARC/1.1\r\n" * 20), (11, "long", prose(60_000, 2))]
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def test_round_trip(spark, tmp_path):
    save(pages(spark), tmp_path, "pages")
    got = warc.op9_warc(spark, str(tmp_path)).collect()
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    want = con.sql(warc.SQL["op9_warc"])
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    assert sorted(str(tuple(r[c] for c in columns)) for r in got) == sorted(str(r) for r in want.select(*columns).fetchall())
    assert {r["page_id"]: r["refers_to"] for r in got if r["record_type"] == "revisit"} == {5: 3, 9: 3, None: 3, 8: 7}


def test_payloads_come_back(spark):
    folder, manifest = warc.write_archives(pages(spark).repartition(2), archive_bytes=1000)
    rows = warc.read_archives(spark, folder, manifest).collect()
    back = {warc.page_of(r["record"]): bytes(r["payload"]) for r in rows if r["record_type"] == "response"}
    assert back == {r["page_id"]: (r["html"] or "").encode() for r in pages(spark).collect() if r["page_id"] in back}
    assert manifest.count() >= 2 and manifest.groupBy().sum("records").first()[0] == 12
    assert warc.read_archives(spark, folder).count() == 12


def test_pages_with_clashing_columns(spark, tmp_path):
    """Other columns are not read, whatever their names."""
    rows = pages(spark).selectExpr("*", "'x' as digest", "1 as first", "2 as n", "'y' as record_type", "3 as payload")
    save(rows, tmp_path, "pages")
    assert warc.op9_warc(spark, str(tmp_path)).count() == rows.count()


def test_no_pages(spark, tmp_path):
    save(pages(spark).where("false"), tmp_path, "pages")
    assert warc.op9_warc(spark, str(tmp_path)).count() == 0


def archive(records):
    sink = io.BytesIO()
    sink.close = lambda: None
    writer = warc.ArchiveWriter(sink)
    for r in records:
        writer.add(r)
    writer.close()
    return sink.getvalue()


def records(n):
    return [warc.build_record(k, f"http://h/{k}", (prose(60, k) + "</html>").encode(), None, hashlib.sha256((prose(60, k) + "</html>").encode()).hexdigest()) for k in range(n)]


def test_archives_have_a_dictionary_and_a_frame_per_record():
    made = records(300)
    data = archive(made)
    assert int.from_bytes(data[:4], "little") == warc.DICT_MAGIC
    frames = list(warc.read_frames(data))
    assert [x for _, x in frames] == made and len({at for at, _ in frames}) == 300
    for at, _ in frames[:5]:
        assert data[at : at + 4] == warc.ZSTD_MAGIC
    for few in (1, 3, 7):
        small = archive(made[:few])
        assert int.from_bytes(small[:4], "little") == warc.DICT_MAGIC and [x for _, x in warc.read_frames(small)] == made[:few]
    frames_alone = b"".join(zstandard.ZstdCompressor().compress(r) for r in made[:3])
    assert [x for _, x in warc.read_frames(frames_alone)] == made[:3]
    size = int.from_bytes(data[4:8], "little")
    packed = zstandard.ZstdCompressor().compress(data[8 : 8 + size])
    again = data[:4] + len(packed).to_bytes(4, "little") + packed + data[8 + size :]
    assert [x for _, x in warc.read_frames(again)] == made


@pytest.mark.parametrize("damage", [lambda d: d[:-3], lambda d: d[:200] if len(d) > 200 else d[:4], lambda d: d + b"junk", lambda d: d[:-20] + bytes(20)])
def test_damaged_archives(damage):
    with pytest.raises(ValueError):
        for _, raw in warc.read_frames(damage(archive(records(20)))):
            warc.parse_http(*warc.parse_record(raw))


@pytest.mark.parametrize("old, new", [(b"WARC/1.1", b"WARX/1.1"), (b"WARC-Date: ", b"WARC-Data: "), (b"Content-Type: text", b"Content-Tape: text"), (b"\r\nContent-Length: ", b"\r\nContent-Length: 1"), (b"the", b"thy"), (b"WARC-Type: ", b"WARC-Type ")])
def test_damaged_records(old, new):
    raw = records(1)[0]
    warc.parse_http(*warc.parse_record(raw))
    with pytest.raises(ValueError):
        warc.parse_http(*warc.parse_record(raw.replace(old, new)))


def make_tables(spark, folder):
    """Clean texts, junk, toxic texts, exact and near copies, with labels for some."""
    rows, labels = [], []
    for k in range(120):
        rows.append((k, f"{prose(90, k)} w{k} " + " ".join(f"u{k}x{j}" for j in range(40)), "en", "s", 1))
        labels.append((k, 1, 0))
    for k in range(120, 170):
        rows.append((k, " ".join(f"{w}{'***' if j % 2 else '&&&'}" for j, w in enumerate(prose(100, k).split())), "en", "s", 1))
        labels.append((k, 0, 0))
    for k in range(170, 230):
        rows.append((k, f"{prose(60, k)} idiot {prose(20, k + 1)} moron u{k} " + " ".join(f"v{k}x{j}" for j in range(30)), "en", "s", 1))
        labels.append((k, 1, 1))
    for k in range(20):
        rows.append((300 + k, rows[k][1].replace(" ", "  "), "en", "s", 1))
    for k in range(20, 40):
        rows.append((400 + k, rows[k][1] + " end", "en", "s", 1))
    rows.append((500, None, None, None, None))
    save(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), folder, "documents")
    save(spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), folder, "labels")


def test_pipeline(spark, tmp_path):
    make_tables(spark, tmp_path)
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    ids = sorted(r["doc_id"] for r in got)
    assert ids == list(range(120))
    assert len({(r["bucket"], r["batch"], r["slot"]) for r in got}) == len(got)


def test_stages_like_brute_force(spark, tmp_path):
    make_tables(spark, tmp_path)
    d = str(tmp_path)
    docs = spark.read.parquet(f"{d}/documents.parquet")
    labels = spark.read.parquet(f"{d}/labels.parquet")
    texts = {r["doc_id"]: (r["text"] or "").encode() for r in docs.collect()}
    model, plain = quality.train(docs, labels), []
    for i, raw in texts.items():
        n, _, _, _, rep = quality.base_counts(raw)
        if not quality.base_failed(n, rep) and quality.probability(raw, model) >= 0.5:
            plain.append(i)
    kept = corpus_pipeline.quality_rules(spark, docs, d)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted(plain)
    tox = toxicity.train(docs, labels)
    calm = corpus_pipeline.toxic_texts(spark, docs, d)
    assert sorted(r["doc_id"] for r in calm.collect()) == sorted(i for i, raw in texts.items() if toxicity.probability(raw, tox["w"], tox["b"]) < 0.5)
    first = {}
    for i in sorted(texts):
        first.setdefault(b" ".join(texts[i].split()), i)
    assert sorted(r["doc_id"] for r in corpus_pipeline.exact_duplicates(spark, docs, d).collect()) == sorted(first.values())
    ids = sorted(texts)
    least = plain_similar([texts[i].decode() for i in ids])
    near = corpus_pipeline.near_duplicates(spark, docs, d)
    assert near.columns == docs.columns and sorted(r["doc_id"] for r in near.collect()) == sorted({ids[k] for k in least})


def test_awkward_documents_pass_all_stages(spark, tmp_path):
    labels = spark.createDataFrame([(1, 1, 0), (None, None, None)], "doc_id long, quality int, toxic int")
    save(labels, tmp_path, "labels")
    for docs in (awkward(spark), empty(spark)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, str(tmp_path))
            if name != "packing":
                assert out.columns == docs.columns
            assert out.count() <= docs.count()
    one_each = corpus_pipeline.exact_duplicates(spark, awkward(spark), str(tmp_path))
    assert one_each.count() == exact_dedup.exact_groups(awkward(spark)).select("text_sha256").distinct().count()


def test_queries_have_their_columns(spark):
    need = {
        "op2_toxicity": "doc_id held_out score predicted", "op3_katz": "doc_id held_out n_tokens n_known train_tokens base_score score", "op4_simhash": "doc_id fingerprint component_id",
        "op6_exact_dedup": "doc_id keep_id group_size kept text_sha256", "op7_bpe": "doc_id n_tokens ids_sha256 decoded_sha256", "op8_quality": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept",
    }
    n = spark.read.parquet(f"{SF}/documents.parquet").count()
    for name, columns in need.items():
        df = QUERIES[name](spark, SF)
        assert set(columns.split()) <= set(df.columns) and df.count() == n
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    for name, sql in SQL.items():
        df, want = QUERIES[name](spark, SF), con.sql(sql)
        assert sorted(str([r[c] for c in want.columns]) for r in df.collect()) == sorted(str(list(r)) for r in want.fetchall())


def test_two_runs_at_once(spark, tmp_path):
    """Both results read after both runs, and each is all that its run leaves."""
    make_tables(spark, tmp_path)
    release(spark)
    first, second = (corpus_pipeline.run(spark, str(tmp_path)) for _ in range(2))
    assert first.count() == second.count() == 120 and len(written()) == 2
    release(spark)
    assert not written()


def test_queries_leave_their_result_only(spark):
    for name in ("op1_langid", "op3_katz", "op4_simhash", "op5_packing", "op6_exact_dedup"):
        release(spark)
        df = QUERIES[name](spark, SF)
        assert len(written()) == 1 and df.count() > 0
    release(spark)


def test_no_shared_folder_off_one_machine(spark, monkeypatch):
    """Without a folder that executors share, a session on a cluster gets an error, not one machine's own folder."""
    from types import SimpleNamespace

    from catalith.llm import common

    bare = SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=SimpleNamespace(master="spark://h:7077", getConf=lambda: SimpleNamespace(get=lambda *_: None)))
    with pytest.raises(RuntimeError):
        common.shared_dir(bare)


def test_near_duplicates_of_all_documents(spark):
    """On all documents of sf0.01: who is dropped has a path of similar texts, and no similar pair is left apart."""
    from catalith.llm import simhash

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = sorted((r["doc_id"], r["text"] or "") for r in docs.collect())
    least = plain_similar([t for _, t in rows])
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_groups(docs, profile=simhash.SIMILAR).collect()}
    assert [got[i] for i, _ in rows] == [rows[k][0] for k in least]


def test_scratch_is_released(spark):
    release(spark)
    exact_dedup.exact_groups(awkward(spark)).count()
    assert written()
    release(spark)
    assert not written()
