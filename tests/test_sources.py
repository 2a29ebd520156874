import pytest
from pyspark.sql import functions as F

from vecloom import schema as S
from vecloom.sources import readers, writers


def test_csv_keeps_quotes_commas_newlines_and_padding(spark, tmp_path):
    rows = [(1, 'a "quoted" title', "p,q", 'line one\nline "two", end'), (2, " padded ", "", "x")]
    df = spark.createDataFrame(rows, S.ITEM_SCHEMA)
    writers.write_csv(df, str(tmp_path / "t"))
    back = readers.read_header_csv(spark, str(tmp_path / "t"), S.ITEM_SCHEMA)
    got = {tuple("" if x is None else x for x in r) for r in back.collect()}
    assert got == set(rows)


def test_append_adds_rows_with_one_header_per_file(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", "p", "r")], S.ITEM_SCHEMA)
    path = str(tmp_path / "t")
    writers.append_csv(df, path)
    writers.append_csv(df, path)
    assert readers.read_header_csv(spark, path, S.ITEM_SCHEMA).count() == 2


def test_tolerant_reader(spark, tmp_path):
    raw = (
        b"TITLE,Provider,Review_Text\n"
        b'  "Alpha", p1,  " long, review ""x""\nsecond line "\n'
        b"short row\n"
        b"Beta,p2,caf\xe9,too,many\n"
        b"Gamma,p3,\n"
    )
    (tmp_path / "r.csv").write_bytes(raw)
    got = {r.title: r.review_text for r in readers.read_reviews(spark, str(tmp_path / "r.csv")).collect()}
    assert got["Alpha"] == 'long, review "x"\nsecond line'
    assert got["Beta"] == "caf�"
    assert got["Gamma"] == ""
    assert "short row" not in got


def test_tolerant_reader_falls_back_to_first_and_last_column(spark, tmp_path):
    (tmp_path / "r.csv").write_text("name,score,body\nA,1,text\n")
    row = readers.read_reviews(spark, str(tmp_path / "r.csv")).first()
    assert (row.title, row.review_text) == ("A", "text")


@pytest.mark.parametrize("multi_line", [True, False])
def test_every_file_counts_by_its_own_header(spark, tmp_path, multi_line):
    folder = tmp_path / "with space"
    folder.mkdir()
    (folder / "a.csv").write_text("title,review\nA,ra\nA2,ra2\n")
    (folder / "b.csv").write_text('review,"title"\nrb,B\n')
    (folder / "c.csv").write_text("\ufeffTITLE,x, Review_Text\nC,1,rc\nshort\n")
    rows = readers.read_reviews(spark, str(folder), multi_line=multi_line).collect()
    assert sorted((r.title, r.review_text) for r in rows) == [("A", "ra"), ("A2", "ra2"), ("B", "rb"), ("C", "rc")]
    (folder / "d.csv").write_text("only\nx\n")
    with pytest.raises(S.ColumnResolutionError):
        readers.read_reviews(spark, str(folder))


def test_tolerant_reader_limit(spark, tmp_path):
    (tmp_path / "r.csv").write_text("title,review\n" + "".join(f"t{i},r{i}\n" for i in range(20)))
    assert readers.read_reviews(spark, str(tmp_path / "r.csv"), limit=7).count() == 7


def test_json_array_form(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"title":"A","cluster":1,"tsneX":0.5},\n {"title":"B"}]')
    rows = readers.read_json_records(
        spark, str(tmp_path / "a.json"), S.SUMMARY_LAYOUT_SCHEMA, one_array=True
    ).orderBy("title").collect()
    assert [(r.title, r.cluster, r.tsneX) for r in rows] == [("A", 1, 0.5), ("B", None, None)]


def test_json_arrays_are_bounded(spark):
    import json

    from vecloom.plans.catalog import _json_arrays

    rows = [(k, None if k % 10 == 0 else k % 3 // 2, f"t{k}") for k in range(400)]
    arrays = _json_arrays(spark.createDataFrame(rows, "item_id long, cluster int, title string"), "item_id", 25).collect()
    parts = [json.loads(r.value) for r in arrays]
    assert max(map(len, parts)) <= 50 and {"title"} <= set(parts[0][0]) <= {"title", "cluster"}
    assert sorted(r["title"] for part in parts for r in part) == sorted(t for _, _, t in rows)


def test_cluster_info_map(spark):
    import json

    info = spark.createDataFrame(
        [(1, 2, "#36A2EB", ["a", "b"]), (0, 1, "#FF6384", ["c"])],
        "cluster int, count long, color string, sample_games array<string>",
    )
    parsed = json.loads(writers.cluster_info_json(info).first()["json"])
    assert parsed["1"] == {"count": 2, "color": "#36A2EB", "sample_games": ["a", "b"]}
    assert list(parsed) == ["0", "1"]


def test_column_resolution():
    assert S.title_column(["id", "game_title"]) == "game_title"
    assert S.title_column(["a", "b"]) == "a"
    assert S.summary_column(["x", "my_summary"]) == "my_summary"
    assert S.review_column(["review", "review_text"]) == "review_text"
    assert S.review_column(["a", "the_review_col"]) == "the_review_col"
    assert S.review_column(["a"]) is None
    with pytest.raises(S.ColumnResolutionError):
        S.summary_column(["a"])


def test_case_clash_is_refused(spark):
    spark.conf.set("spark.sql.caseSensitive", "true")
    try:
        df = spark.createDataFrame([(1, 2)], "A int, a int")
        with pytest.raises(S.ColumnResolutionError):
            S.normalise_columns(df)
    finally:
        spark.conf.set("spark.sql.caseSensitive", "false")


def test_combined_text_keeps_separators_of_nulls(spark):
    df = spark.createDataFrame([("a", None, "c")], "Text1 string, MyText string, TextEnd string")
    assert S.combine_text_columns(df).first()["combined_text"] == "a  c"


def test_vector_pack_and_unpack_are_inverse(spark):
    df = spark.createDataFrame([(7, "x", 1.5, 2.5, -3.0)], "id int, n string, a double, b double, c double")
    packed = S.pack_vector(df, 3)
    assert packed.first()["embedding"] == [1.5, 2.5, -3.0]
    assert S.unpack_vector(packed, 3, prefix="e").first().asDict() == {
        "id": 7, "n": "x", "e0": 1.5, "e1": 2.5, "e2": -3.0,
    }
    with pytest.raises(S.ColumnResolutionError):
        S.pack_vector(df, 9)


def test_layout_defaults_and_palette(spark):
    df = spark.createDataFrame(
        [(4, 0.0, 0.0, 0.0, 8), (5, 0.0, 0.0, 0.0, 9)], "item_id long, x double, y double, z double, cluster int"
    )
    rows = S.to_layout(df).orderBy("id").collect()
    assert rows[0].name == "Game 4" and rows[0].description == "" and rows[0].color == "#4BC0C0"
    assert rows[1].color is None  # no tenth colour
    assert S.to_layout(df).schema.simpleString() == S.LAYOUT_SCHEMA.simpleString()


def test_provider_is_always_present(spark):
    df = spark.createDataFrame([(1, "t", 0, "s", None)], "item_id long, title string, cluster int, summary string, provider string")
    assert S.cluster_table(df).first()["provider"] == ""
    assert S.with_default_columns(df.drop("provider")).select(F.col("provider")).first()[0] == ""
