import glob
import hashlib
import zipfile

import pytest
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import types as T

from furrow import model as M
from furrow.operators import fit
from furrow.operators import manifest as R
from furrow.operators.catalog import catalog_list, catalog_search, catalog_summary
from furrow.operators.profile import typed as P_typed
from furrow.operators.transform import transform
from furrow.plans import pipeline as P
from furrow.sources import csv as C
from furrow.sources import dialects as D
from furrow.sources import tables, xlsx
from furrow.streaming import apply

WESTERN = "customer,city,amount\nAndré,Montréal,18\nAnaïs,Zürich,21\n"
CHINESE = "姓名,城市,分数\n张三,上海,91\n李四,北京,87\n"


def put(folder, name, data):
    (folder / name).write_bytes(data if isinstance(data, bytes) else data.encode())
    return str(folder / name)


@pytest.mark.parametrize("data, encoding, delimiter, columns", [
    (b"name;score\nA;1\nB;2\n", "utf-8", ";", ["name", "score"]),
    (b"a\tb\n1\t2\n", "utf-8", "\t", ["a", "b"]),
    (b"a|b\n1|2\n", "utf-8", "|", ["a", "b"]),
    (b"\xef\xbb\xbfa,b\n1,2\n", "utf-8", ",", ["a", "b"]),
    (WESTERN.encode("windows-1252"), "windows-1252", ",", ["customer", "city", "amount"]),
    (CHINESE.encode("gb18030"), "gb18030", ",", ["姓名", "城市", "分数"]),
])
def test_dialects(data, encoding, delimiter, columns):
    found = D.describe(data)
    assert (found["encoding"], found["delimiter"], found["header"]) == (
        encoding, delimiter, columns)


def test_character_cut_by_the_sample_is_no_error():
    head = b"a," + "é".encode() * M.DIALECT_BYTES
    assert D.detect_encoding(head[1:M.DIALECT_BYTES + 1]) == "utf-8"
    assert D.detect_encoding(head[:M.DIALECT_BYTES]) == "utf-8"


def test_header_problems(spark, tmp_path):
    put(tmp_path, "good.csv", "a,b\n1,2\n")
    put(tmp_path, "empty.csv", "")
    put(tmp_path, "blank.csv", "name,,score\nA,x,1\n")
    put(tmp_path, "twice.csv", "name,name \nA,B\n")
    found = D.header_problems(D.csv_dialects(spark, str(tmp_path), "*.csv")).collect()
    assert {r["path"].rsplit("/")[-1]: r["problem"] for r in found} == {
        "empty.csv": "empty_file", "blank.csv": "blank_header", "twice.csv": "duplicate_header"}


@pytest.mark.parametrize("text, encoding", [(WESTERN, "windows-1252"), (CHINESE, "gb18030")])
def test_other_encodings_are_read_as_they_are_profiled(spark, tmp_path, text, encoding):
    df = C.read_csv(spark, put(tmp_path, "x.csv", text.encode(encoding)))
    lines = [line.split(",") for line in text.strip().split("\n")]
    assert df.columns == lines[0]
    assert sorted(str(r[0]) for r in df.collect()) == sorted(r[0] for r in lines[1:])
    assert df.dtypes[2][1] == "bigint"


def test_dates_stay_text_and_whole_numbers_are_wide(spark, tmp_path):
    text = "d,t,n,x\n2024-01-01,2024-01-01 10:00:00,1,1.5\n"
    df = C.read_csv(spark, put(tmp_path, "x.csv", text))
    assert [t for _, t in df.dtypes] == ["string", "string", "bigint", "double"]


@pytest.mark.parametrize("text", ["a,b\n1,2\n3,4,5\n", "a,b\n1,2\n3\n"])
def test_rows_that_do_not_fit_stop_the_read_or_are_set_aside(spark, tmp_path, text):
    path = put(tmp_path, "x.csv", text)
    with pytest.raises((PySparkException, Py4JJavaError), match="MALFORMED"):
        C.read_csv(spark, path).collect()
    schema = T.StructType.fromDDL("a bigint, b bigint")
    parsed = C.read_csv_with_rejects(spark, path, schema)
    assert C.corrupt_rows(parsed).count() == 1 and C.sound_rows(parsed).count() == 1


def test_bad_headers_stop_the_read(spark, tmp_path):
    with pytest.raises(M.PreparationError, match="duplicate_header"):
        C.read_csv(spark, put(tmp_path, "x.csv", "name,name\nA,B\n"))


def test_csv_export_starts_with_a_mark(spark, tmp_path):
    df = spark.createDataFrame([(1, "上海"), (2, 'say "x", y')], "n bigint, c string").repartition(2)
    C.write_csv(df, str(tmp_path / "out"))
    parts = glob.glob(str(tmp_path / "out" / "part-*.csv"))
    assert parts and all(open(p, "rb").read(3) == b"\xef\xbb\xbf" for p in parts)
    back = C.read_csv(spark, str(tmp_path / "out"), delimiter=",", encoding="utf-8")
    assert back.columns == ["n", "c"]
    assert sorted(map(tuple, back.collect())) == [(1, "上海"), (2, 'say "x", y')]


def test_exported_text_is_not_trimmed(spark, tmp_path):
    df = spark.createDataFrame([(1, "  padded "), (2, "a;b"), (3, None)], "n bigint, c string")
    C.write_csv(df, str(tmp_path / "out"), delimiter=";")
    back = C.read_csv(spark, str(tmp_path / "out"), delimiter=";", encoding="utf-8")
    assert sorted(map(tuple, back.collect())) == [(1, "  padded "), (2, "a;b"), (3, None)]


def test_line_breaks_and_doubled_quotes_inside_quotes(spark, tmp_path):
    text = 'a,b\n1,"x\ny ""z"""\n2,plain\n'
    df = C.read_csv(spark, put(tmp_path, "x.csv", text), ",", "utf-8", multiline=True)
    assert sorted(map(tuple, df.collect())) == [(1, 'x\ny "z"'), (2, "plain")]


def test_text_types(spark):
    df = spark.createDataFrame(
        [("1", "1", "true", "2024-01-02", "x", None), ("-2", "2.5", "False", "2024-01-03 10:00:00",
                                                       "1", None),
         (None, None, None, None, None, None)], "i string, f string, b string, d string, s string, "
        "n string")
    assert [t for _, t in P_typed(df, True).dtypes] == [
        "bigint", "double", "boolean", "timestamp_ntz", "string", "string"]
    assert [t for _, t in P_typed(df).dtypes][3] == "string"


def workbook(path, rows, second=None, active=0, shared=("name", "score"), styles=None):
    def sheet(body):
        return ('<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main">'
                f"<sheetData>{body}</sheetData></worksheet>")

    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    with zipfile.ZipFile(path, "w") as book:
        book.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{rel}"><bookViews>'
                      f'<workbookView activeTab="{active}"/></bookViews><sheets>'
                      '<sheet name="First" sheetId="1" r:id="rId1"/>'
                      '<sheet name="Second" sheetId="2" r:id="rId2"/></sheets></workbook>')
        book.writestr("xl/_rels/workbook.xml.rels",
                      '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/'
                      'relationships"><Relationship Id="rId1" Target="worksheets/sheet1.xml"/>'
                      '<Relationship Id="rId2" Target="/xl/worksheets/sheet2.xml"/>'
                      "</Relationships>")
        book.writestr("xl/sharedStrings.xml", f'<sst xmlns="{main}">' + "".join(
            f"<si><t>{s}</t></si>" for s in shared) + "</sst>")
        if styles:
            book.writestr("xl/styles.xml", f'<styleSheet xmlns="{main}">{styles}</styleSheet>')
        book.writestr("xl/worksheets/sheet1.xml", sheet(rows))
        book.writestr("xl/worksheets/sheet2.xml", sheet(second or ""))


HEADER = '<row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c></row>'


def test_workbooks(spark, tmp_path):
    body = (HEADER + '<row r="2"><c r="A2" t="inlineStr"><is><t>Ann</t></is></c>'
            '<c r="B2"><f>1+1</f><v>2</v></c></row>'
            '<row r="3"><c r="B3" t="b"><v>1</v></c></row>')
    workbook(tmp_path / "good.xlsx", body)
    workbook(tmp_path / "other.xlsx", "", second=body, active=1)
    workbook(tmp_path / "twice.xlsx", HEADER, shared=("name", "name "))
    workbook(tmp_path / "blank.xlsx", HEADER, shared=("name", " "))
    workbook(tmp_path / "empty.xlsx", "")
    put(tmp_path, "broken.xlsx", "no zip")
    rows = xlsx.read_workbooks(spark, str(tmp_path))
    found = {}
    for r in rows.collect():
        found.setdefault(r["path"].rsplit("/")[-1], []).append(r["cells"] or r["error"])
    want = [["Ann", "2"], [None, "true"]]
    assert found == {"good.xlsx": want, "other.xlsx": want, "twice.xlsx": ["duplicate_header"],
                     "blank.xlsx": ["blank_header"], "empty.xlsx": ["empty_sheet"],
                     "broken.xlsx": ["not_a_workbook"]}
    table = xlsx.workbook_table(rows, ["name", "score"])
    assert table.columns == ["name", "score"] and table.count() == 4
    assert xlsx.read_workbooks(spark, str(tmp_path), 1).where("error is null").count() == 2


def test_workbook_dates_numbers_and_types(spark, tmp_path):
    styles = ('<numFmts><numFmt numFmtId="164" formatCode="yyyy\\-mm"/>'
              '<numFmt numFmtId="165" formatCode="0.0 &quot;days&quot;"/></numFmts><cellXfs>'
              '<xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="164"/><xf numFmtId="165"/>'
              "</cellXfs>")
    body = (HEADER + '<row r="2"><c r="A2" s="1"><v>45293</v></c><c r="B2" s="3"><v>1.5</v></c></row>'
            '<row r="3"><c r="A3" s="2"><v>45293.5</v></c><c r="B3"><v>2</v></c></row>')
    workbook(tmp_path / "dates.xlsx", body, styles=styles)
    rows = xlsx.read_workbooks(spark, str(tmp_path))
    frame = xlsx.workbook_frame(rows, ["name", "score"])
    assert frame.dtypes == [("name", "timestamp_ntz"), ("score", "double")]
    assert sorted(str(r["name"]) for r in frame.collect()) == [
        "2024-01-02 00:00:00", "2024-01-02 12:00:00"]


def test_files_and_tables_have_fingerprints(spark, tmp_path):
    put(tmp_path, "a.bin", b"abc" * 1_000_000)
    put(tmp_path, "b.bin", b"")
    found = {r["path"].rsplit("/")[-1]: r for r in tables.file_sha256(
        spark, str(tmp_path), "*.bin").collect()}
    assert found["a.bin"]["sha256"] == hashlib.sha256(b"abc" * 1_000_000).hexdigest()
    assert found["a.bin"]["size"] == 3_000_000
    assert found["b.bin"]["sha256"] == hashlib.sha256(b"").hexdigest()
    df = spark.range(300).selectExpr("id", "nullif(id % 5, 0) as x", "cast(id as double) / 3 as d")
    prints = {tables.table_fingerprint(d).head()["fingerprint"]
              for d in (df, df.repartition(9), df.orderBy("d"))}
    assert len(prints) == 1
    assert tables.table_fingerprint(df.where("id > 0")).head()["fingerprint"] not in prints


def test_different_tables_have_different_fingerprints(spark):
    schema = "a string, b string, x double"
    rows = [("a|b", "c", 1e-9), ("a", "b|c", 1e-9), ("a|b", "c", 4e-9), ("a|b", None, 1e-9),
            ("a|b", "\u0001", 1e-9), (None, "a|b", 1e-9), ("a|bc", "", 1e-9), ("a|b", "c", None)]
    one = [tables.table_fingerprint(spark.createDataFrame([r], schema)).head() for r in rows]
    assert len({r["fingerprint"] for r in one}) == len(rows)
    both = tables.table_fingerprint(spark.createDataFrame([rows[0]] * 2, schema)).head()
    assert both["rows"] == 2 and both["fingerprint"] != one[0]["fingerprint"]
    none = tables.table_fingerprint(spark.createDataFrame([], schema)).head()
    assert (none["rows"], none["fingerprint"]) == (0, "0-0")


def test_missing_working_table_is_named(spark, tmp_path):
    with pytest.raises(M.PreparationError, match="missing"):
        tables.read_parquet(spark, str(tmp_path / "none"))


def test_state_as_json_files(spark, tmp_path):
    state = fit.FittedState([fit.ColumnState("城市", 0, "categorical", fill_str="上海",
                                             categories=["上海", "北京"], truncated=False)])
    tables.write_json(state.to_dataframe(spark), str(tmp_path / "state"))
    back = spark.read.schema(fit.STATE_SCHEMA).json(str(tmp_path / "state"))
    assert fit.FittedState.from_dataframe(back) == state


def test_manifest_artifacts_and_staleness(spark, tmp_path, segments):
    from conftest import SEGMENT_ROLES

    run = P.run_supervised(segments, SEGMENT_ROLES, M.CLASSIFICATION, key=["row_id"])
    path = str(tmp_path / "manifest")
    for run_id in ("r1", "r2"):
        R.append_manifest(R.run_manifest(run, spark, "p", run_id, "42", ["b", "a"]), path)
    stored = spark.read.parquet(path)
    last = R.latest_run(stored).head()
    assert last["run_id"] == "r2" and last["train_rows"] == 16 and last["test_rows"] == 4
    assert last["applied_recommendation_ids"] == ["a", "b"] and last["target_missing_rows"] == 1
    assert fit.FittedState.from_json(last["learned"]) == run.state
    artifacts = {r["name"]: r for r in R.write_artifacts(run, str(tmp_path / "run"), "r2").collect()}
    assert {n: a["rows"] for n, a in artifacts.items()} == {
        "train": 16, "test": 4, "raw_train": 16, "raw_test": 4, "target_missing": 1}
    same = R.upstream_fingerprint(SEGMENT_ROLES, ["a", "b"], run.config.as_dict())
    changed = R.upstream_fingerprint(SEGMENT_ROLES, ["a"], run.config.as_dict())
    schema = "project_id string, upstream string"
    assert R.stale_runs(stored, spark.createDataFrame([("p", same)], schema)).count() == 0
    assert R.stale_runs(stored, spark.createDataFrame([("p", changed)], schema)).count() == 2


def test_catalog(spark):
    rows = [("1", "Churn", "a.csv", "classification", "ready", 10, 1),
            ("2", "Prices", "B.CSV", "regression", "processing", 20, 3),
            ("3", "Tidy", "c.csv", "cleaning", "running", 30, 2)]
    df = spark.createDataFrame(rows, "id string, name string, source_filename string, "
                               "task_type string, status string, source_size bigint, "
                               "created_at bigint")
    assert [r["id"] for r in catalog_list(df).collect()] == ["2", "3", "1"]
    assert [r["id"] for r in catalog_search(df, " b.csv ").collect()] == ["2"]
    assert [r["id"] for r in catalog_search(df, "分类").collect()] == ["1"]
    assert catalog_search(df, "  ").count() == 3
    assert catalog_summary(df).head().asDict() == {"active": 2, "storage": 60}


def test_stream_equals_batch_and_is_not_refitted(spark, tmp_path):
    df = spark.range(200).selectExpr("id", "case when id % 9 > 0 then id * 0.5 end as x",
                                     "concat('c', id % 4) as c")
    roles = {"x": "continuous_numeric", "c": "nominal_category"}
    state = fit.fit(df.where("id < 100 and c <> 'c3'"), roles, ["x", "c"], ["x"],
                    M.PipelineConfig())
    source = str(tmp_path / "in")
    df.repartition(3).write.parquet(source)
    for _ in range(2):
        stream = apply.transform_stream(spark, source, df.schema, state, ["id"], 1)
        apply.write_available(stream, str(tmp_path / "out"), str(tmp_path / "marks")
                              ).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    want = transform(df, state, keep=["id"])
    assert got.exceptAll(want).count() == 0 and got.count() == 200
    assert got.where("c__unknown = 1").count() == 50


def test_line_breaks_in_quotes_are_found(spark, tmp_path):
    df = C.read_csv(spark, put(tmp_path, "x.csv", 'a,b\n1,"x\ny"\n2,"say ""hi"""\n'))
    assert sorted(map(tuple, df.collect())) == [(1, "x\ny"), (2, 'say "hi"')]


def test_late_bytes_outside_the_encoding_are_refused(spark, tmp_path):
    data = b"name\n" + b"plain text\n" * 20_000 + "caf\u00e9\n".encode("windows-1252")
    with pytest.raises(M.PreparationError, match="not utf-8"):
        C.read_csv(spark, put(tmp_path, "x.csv", data))


def test_header_is_checked_with_a_given_dialect(spark, tmp_path):
    with pytest.raises(M.PreparationError, match="duplicate_header"):
        C.read_csv(spark, put(tmp_path, "x.csv", "name,name\nA,B\n"), ",", "utf-8")
