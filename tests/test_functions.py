import gzip

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from catalith.functions import scalars as s
from catalith.functions.rtf import rtf_to_html
from catalith.functions.rtf.columns import placeholders, render_html, token_rows
from catalith.functions.rtf.html import tenths
from catalith.functions.rtf.lexer import tokens


def one(spark, value, fn, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(fn(F.col("x")).alias("y")).first()["y"]


def test_parameters():
    assert [s.parse_id(x) for x in ("12abc", " -3", "x", "", None)] == [12, -3, None, None, None]
    assert s.parse_id_list("1,,2,a, 3 ,4.5") == [1, 2, 3] and s.parse_id_list(None) == []
    assert s.code_search_input("12-34567", "IB", 6, 4) == "1234"
    assert s.code_search_input("1", "IB", 6, 4) is None and s.code_search_input("12", "", 0, 0) is None


def test_columns(spark):
    assert one(spark, "12abc", s.id_of) == 12 and one(spark, "x", s.id_of) is None
    assert one(spark, "1,,2,a", s.ids_of) == [1, 2] and one(spark, None, s.ids_of) == []
    assert one(spark, "ZZZZZ", s.base36) == 60466175 and one(spark, "a*", s.base36) is None
    assert one(spark, "WBAAA00000AB12345", s.vin_area) == 371 and one(spark, "WBAAA00000AB12345", s.vin_serial) == 1776965
    assert [one(spark, x, lambda c: s.date_text(c, True), "int") for x in (20240131, 202401, 7, None)] == ["2024-01-31", "2024-01", "7", None]
    assert one(spark, 202401, s.date_text, "int") == "202401" and one(spark, 199512, s.year, "int") == "1995"
    assert one(spark, "a/B.JPEG", s.mime_type) == "image/jpeg" and one(spark, "a.b/c", s.mime_type) == "application/octet-stream"
    assert one(spark, "N:GRAFIK\\1\\03.ITW;x", s.image_path) == "1/03.png" and one(spark, "no", s.image_path) is None
    assert one(spark, b"\xe9", s.latin1, "binary") == "é"
    assert tuple(one(spark, "5.3000.-1", s.parse_node_key)) == (5, 3000, -1) and one(spark, "5.3000", s.parse_node_key) is None
    assert one(spark, "a", lambda c: s.vehicle_summary(c, F.lit(""), F.lit("b"))) == "a / b"
    assert one(spark, 1600, lambda c: s.label_map(c, {1600: "ISB"}), "int") == "ISB" and one(spark, 7, lambda c: s.label_map(c, {1600: "ISB"}), "int") == "7"


LINK = '<a class="tis-cross-ref" data-hotspot="{}" href="#">{}</a>'


@pytest.mark.parametrize("rtf, html", [
    (r"{\rtf1 \b Hi\b0  there\par}", "<p><strong>Hi</strong> there</p>\n"),
    (r"\strike 00\~0\~200\strike0  x", f"<p>{LINK.format(1, '00' + chr(160) + '0' + chr(160) + '200')} x</p>\n"),
    (r"\strike a\par\strike b", f"<p>{LINK.format(1, 'a')}</p>\n<p>{LINK.format(2, 'b')}</p>\n"),
    (r"\strike a\line b", f"<p>{LINK.format(1, 'a')}<br>{LINK.format(2, 'b')}</p>\n"),
    (r"\plain\v .Z.\plain N:GRAFIK\\1\\03\\47\\65.itw;11cm;8cm;TIFF;", '<p></p>\n<img src="/api/images/1/03/47/65.png" alt="Technical illustration" class="tis-inline-image" loading="lazy" />\n'),
    (r"{\v N:GRAFIK\'5c1\'5c2.itw;}z", '<p></p>\n<img src="/api/images/1/2.png" alt="Technical illustration" class="tis-inline-image" loading="lazy" />\nz'),
    (r"\trowd\trleft100\cellx1100\cellx3100\intbl A\cell B\cell\row after", '<table class="tis-layout-table" style="margin-left:5pt;width:150pt">\n<tbody>\n<tr><td class="tis-text-cell" style="width:33.3%"><p>A</p>\n</td><td class="tis-text-cell" style="width:66.7%"><p>B</p>\n</td></tr>\n</tbody>\n</table>\n<p>after</p>\n'),
    (r"\up6 a\nosupersub b\dn c<&>" + '"', "<p><sup>a</sup>b<sub>c&lt;&amp;&gt;&quot;</sub></p>\n"),
    (r"\li200\fi-30\sb10 x", '<p style="margin-left:10pt;text-indent:-1.5pt;margin-top:0.5pt">x</p>\n'),
    (r"{\fonttbl{\f0 Arial;}}\f1 \'b7\f0 \'b7 --TYP--", "<p>•· E46</p>\n"),
    ("a\r\nb\\tab c\\", "<p>ab&emsp;c</p>\n"),
    ("", ""),
])
def test_rich_text(rtf, html):
    assert rtf_to_html(rtf, placeholders(typ="E46")) == html


def test_tokens():
    found = [(t.kind, t.word, t.param) for t in tokens(r"\fs20 a\li-200\'b7\'zz{\*}")]
    assert found == [("word", "fs", 20), ("text", "a", None), ("word", "li", -200), ("byte", "", 0xB7), ("byte", "", None), ("open", "", None), ("symbol", "*", None), ("close", "", None)]


@given(st.text(alphabet="{}\\ab0-' \r\n<~", max_size=60))
def test_any_text_renders(text):
    assert not rtf_to_html(text).startswith("<pre")
    assert "".join(t.word for t in tokens(text) if t.kind == "text").replace("\\", "") == "".join(t.word for t in tokens(text) if t.kind == "text")


@given(st.lists(st.booleans(), max_size=12))
def test_links_are_numbered_from_one(struck):
    html = rtf_to_html("".join(r"\strike x\par " if on else r"\strike0 y\par " for on in struck))
    assert [f'data-hotspot="{k}"' in html for k in range(1, len(struck) + 2)] == [k <= sum(struck) for k in range(1, len(struck) + 2)]


def test_rounding():
    assert [tenths(x) for x in (5.0, 33.33, 0.25, -1.25, -0.05)] == ["5", "33.3", "0.3", "-1.2", "0"]


def test_rich_text_columns(spark):
    rows = spark.createDataFrame([(1, r"\b x"), (2, None)], "id long, t string")
    assert [r["h"] for r in rows.select(render_html(F.col("t")).alias("h")).collect()] == ["<p><strong>x</strong></p>\n", None]
    assert [(r["pos"], r["word"]) for r in token_rows(rows, "id", "t").collect()] == [(0, "b"), (1, "x")]


def test_ingest(spark, tmp_path):
    from catalith.sources import ingest as g

    source, out = tmp_path / "in", tmp_path / "out"
    for sub in ("DATA", "DOCS/Sub", "GRAFIK/1"):
        (source / sub).mkdir(parents=True)
    (source / "DATA/TBENENNUNG.csv").write_text('KEY,BENENNUNG\n1,"a, b"\nx,c\n')
    (source / "DATA/THGR000200.csv").write_text("KNOTEN_ID,INFOOBJ_ID,SECURITY\n10,1,0\n")
    (source / "DATA/THGR000300.csv").write_text("KNOTEN_ID,INFOOBJ_ID,SECURITY\n11,2,0\n")
    (source / "DOCS/Sub/a.RTF").write_bytes(gzip.compress(b"{\\rtf1 x}"))
    (source / "DOCS/b.rtf").write_bytes(b"plain")
    (source / "GRAFIK/1/p.PNG").write_bytes(b"png")
    (source / "GRAFIK/1/p.txt").write_bytes(b"no")
    log = g.ingest(spark, str(source), str(out))
    assert log["tables"] == [("TBENENNUNG.csv", "label", 2), ("THGR000200.csv", "node_document", 1), ("THGR000300.csv", "node_document", 1)] and log["warnings"] == []
    _, rejected = g.read_export(spark, str(source / "DATA/TBENENNUNG.csv"), "label")
    assert tuple(rejected.first()) == (1, 0)
    assert g.ingest(spark, str(source), str(out))["tables"] == log["tables"] and spark.read.parquet(str(out / "node_document")).count() == 2
    docs = {r["id"]: (r["path"], bytes(r["data"])) for r in spark.read.parquet(str(out / "doc_blob")).collect()}
    assert docs == {"SUB/A.RTF": ("Sub", b"{\\rtf1 x}"), "B.RTF": ("", b"plain")}
    images = spark.read.parquet(str(out / "image_blob"))
    assert [(r["id"], r["content_type"]) for r in images.collect()] == [("1/P.PNG", "image/png")]
    g.append_new(images, str(out / "image_blob"))
    assert spark.read.parquet(str(out / "image_blob")).count() == 1
    tables = {"doc_blob": spark.read.parquet(str(out / "doc_blob")), "image_blob": images}
    assert g.extract_data(tables, "both", str(tmp_path / "x")) == {"images": 1, "docs": 2}
    assert (tmp_path / "x/docs/SUB/A.RTF").read_bytes() == b"{\\rtf1 x}"
    assert g.extract_one(images, str(tmp_path / "y"), "1/p.png") == 3
    with pytest.raises(LookupError):
        g.extract_one(images, str(tmp_path / "y"), "none")
    with pytest.raises(ValueError):
        g.extract_data(tables, "both", str(tmp_path / "x"), "a")
    with pytest.raises(FileNotFoundError):
        g.ingest(spark, str(tmp_path), str(out))


def lzw(data: bytes, most: int = 12) -> bytes:
    """A plain .Z compressor without clear codes, to test the reader."""
    table, out, bits, n, width, group = {bytes([b]): b for b in range(256)}, bytearray(b"\x1f\x9d" + bytes([0x80 | most])), 0, 0, 9, 0
    size, codes, current = 257, [], b""
    for byte in data:
        longer = current + bytes([byte])
        if longer in table:
            current = longer
            continue
        codes.append(table[current])
        if size < 1 << most:
            table[longer], size = size, size + 1
        current = bytes([byte])
    codes.append(table[current])
    seen = 257
    for k, code in enumerate(codes):
        bits |= code << n
        n += width
        group += 1
        if k and seen < 1 << most:
            seen += 1
            if seen == 1 << width and width < most:
                n += (-group % 8) * width
                width, group = width + 1, 0
    return bytes(out) + bits.to_bytes((n + 7) // 8, "little")


@given(st.lists(st.sampled_from([b"ab", b"abc", b"x", b"\x00\xff"]), min_size=1, max_size=900))
def test_lzw(parts):
    from catalith.sources.ingest import unlzw

    assert unlzw(lzw(b"".join(parts))) == b"".join(parts)


def test_arrivals(spark, tmp_path):
    from catalith.streaming.arrivals import arriving_files, store_arrivals

    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.rtf").write_bytes(b"x")
    for _ in range(2):
        store_arrivals(arriving_files(spark, str(tmp_path / "in"), ["rtf"]), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert [r["id"] for r in spark.read.parquet(str(tmp_path / "out")).collect()] == ["A.RTF"]
