"""Archives and licence lines as others write them."""

import gzip

import pytest

from furrow.llm import archive, licenses

V1 = "URL IP-address Archive-date Content-type Archive-length"
V2 = ("URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename "
      "Archive-length")


def arc(version, fields, records, name="IA-001.arc"):
    body = f"{version} 0 Some Archive\n{fields}\n"
    plain = {"Content-type": "text/plain", "Result-code": "200", "Checksum": "-", "Location": "-",
             "Offset": "0", "Filename": name, "IP-address": "1.2.3.4", "Archive-date": "19970417175710"}

    def header(url, content, fields=fields):
        values = {**plain, "URL": url, "Archive-length": str(len(content.encode()))}
        return " ".join(values[f] for f in fields.split())

    # The line before the declaration is in the order of the version.
    lines = [header(f"filedesc://{name}", body, V1 if version == 1 else V2) + "\n" + body]
    return "".join(lines + [f"\n{header(u, c)}\n{c}" for u, c in records]).encode()


RECORDS = [("http://a/", "HTTP/1.0 200 OK\r\nX-Page-Id: 7\r\n\r\nbody ä"), ("http://b/", "no http")]


def test_all_files_are_read(spark, tmp_path):
    (tmp_path / "deep").mkdir()
    (tmp_path / "IA-001.arc.gz").write_bytes(gzip.compress(arc(1, V1, RECORDS)))
    (tmp_path / "deep" / "IA-001.arc").write_bytes(arc(2, V2, RECORDS))
    # A file may declare its fields in another order than its version's.
    (tmp_path / "own.arc").write_bytes(arc(
        1, "URL Archive-length IP-address Archive-date Content-type", RECORDS))
    (tmp_path / "empty.arc").write_bytes(b"")
    rows = archive.read_arc(spark, str(tmp_path)).collect()
    assert sorted((r.url, r.payload.decode(), r.page_id) for r in rows) == sorted(
        [("http://a/", "body ä", 7), ("http://b/", "no http", None)] * 3)
    assert len({r.record_id for r in rows}) == 6
    assert {r.date for r in rows} == {"1997-04-17T17:57:10Z"} and {r.ip for r in rows} == {"1.2.3.4"}
    again = archive.read_arc(spark, f"file://{tmp_path}/").collect()
    assert {r.record_id for r in again} == {r.record_id for r in rows}
    archive.convert(spark, str(tmp_path), f"{tmp_path}-warc")
    back = archive.read_warc(spark, f"{tmp_path}-warc").collect()
    assert sorted(r.record_type for r in back) == ["resource"] + ["response"] + ["revisit"] * 4


@pytest.mark.parametrize("content, message", [
    (b"<html>no archive</html>\n", "no ARC file"),
    (arc(1, V1.replace(" IP-address", ""), []), "declared without"),
    (arc(1, V1, RECORDS)[:-3], "bytes declared"),
])
def test_what_is_no_archive_is_refused(content, message):
    with pytest.raises(ValueError, match=message):
        list(archive.arc_records(content))


def test_owners_of_any_length(spark):
    owners = " ".join(f"Copyright (c) {1980 + i} Owner Number {i}," for i in range(40))
    lines = [f"{owners} Released under the MIT License.", owners,
             f"Released under the MIT License. {owners}", "Released under the MIT License.",
             f"See © 2020 A, licensed under nothing {owners} released under the MIT License."]
    rows = licenses.license_scan(spark.createDataFrame(
        list(enumerate(lines)), "doc_id long, text string")).collect()
    found = {r.doc_id: r.notice_ids for r in rows}
    assert found[0] == found[3] == "MIT" and found[1] == ""
    # A line that also names an owner after the notice is no notice by itself.
    assert found[2] == found[4] == ""
    assert rows[0].canonical_sha256 == rows[3].canonical_sha256


def test_a_very_long_line_of_owners(spark):
    line = "(c) 2020 x, licensed under y " * 40_000
    row = licenses.license_scan(spark.createDataFrame([(1, line)], "doc_id long, text string")).head()
    assert row.notice_ids == "" and row.license_id is None
