"""CSV ingest, layers, gates and contracts."""

import csv as plain_csv
import random

import pytest
from pyspark.sql import functions as F

from hirelake.fixed_values import CLEANED_TABLES
from hirelake.operators import ordering
from hirelake.sources import csv, layers, split_csv, staging, versions


@pytest.fixture
def layer(spark, tmp_path):
    name = f"layer_{abs(hash(str(tmp_path)))}"
    layers.create_namespaces(spark, [name], str(tmp_path))
    return name


def test_quoted_breaks_quotes_and_na(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text('id,text,note\n1,"line1\nline2 ""q"", x",NA\n2,"", NA \n')
    table = csv.read_csv_tables(spark, {"t": str(path)}, {"t": "id bigint, note string"})["t"]
    assert table.drop("_seq").collect() == [(1, 'line1\nline2 "q", x', None), (2, None, " NA ")]


def test_columns_go_by_name_and_bad_values_become_null(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text("views,job_id,extra\n3.0,7,a\nmany,8.0,b\n")
    table = csv.read_csv_tables(spark, {"t": str(path)}, {"t": "job_id bigint, views double, absent string"})["t"]
    assert table.select("job_id", "views", "extra").collect() == [(7, 3.0, "a"), (8, None, "b")]


def test_missing_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x\n1\n")
    paths = {"a": str(tmp_path / "a.csv"), "b": str(tmp_path / "b.csv")}
    with pytest.raises(FileNotFoundError):
        csv.read_csv_tables(spark, paths)
    assert list(csv.read_csv_tables(spark, paths, strict=False)) == ["a"]


def messy_records(n):
    rng = random.Random(5)
    alphabet = ['a', 'é', ',', '"', '\n', ' ', '\n\n', '""', 'word']
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(12))) for _ in range(n)]
    texts[n // 2] = "long\n" * 900
    return [(str(i), t, rng.choice(["x", 'say "hi"', ""])) for i, t in enumerate(texts)]


@pytest.fixture(params=[64, 700, 1 << 20])
def split_bytes(spark, request):
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = [spark.conf.get(n) for n in names]
    spark.conf.set(names[0], request.param)
    spark.conf.set(names[1], 1)
    yield request.param
    for name, value in zip(names, before):
        spark.conf.set(name, value)


def values(df):
    return [tuple(r)[:-1] for r in sorted(df.collect(), key=lambda r: tuple(r["_seq"]))]


def test_split_files_give_the_same_records_as_whole_files(spark, tmp_path, split_bytes):
    for part in ("a", "b"):
        with open(tmp_path / f"{part}.csv", "w", newline="") as file:
            writer = plain_csv.writer(file, lineterminator="\n", quoting=plain_csv.QUOTE_MINIMAL)
            writer.writerows([("id", "text", "note"), *messy_records(150)])
    whole = values(csv.read_csv(spark, str(tmp_path), "whole"))
    split = csv.read_csv(spark, str(tmp_path), "split")
    assert values(split) == whole
    numbered = ordering.sequential_id(split, ["_seq"], ["n"]).orderBy("_seq").select("n").collect()
    assert [r.n for r in numbered] == list(range(1, 301))
    assert [t or "" for _, t, _ in whole][:150] == [t for _, t, _ in messy_records(150)]


STRAY = 'id,t\n1,5\' 11" tall\n2,b\n3,c\n4,d 6" e\n5,f\n'
TEXTS = {
    "stray quotes": STRAY,
    "empty lines": "\n\nid,t\n\n1,a\n\n\n2,b",
    "carriage returns": 'id,t\r\n1,"a\r\nb"\r\n\r\n2,"c"\r\n3,d "q"\r\n',
    "mixed line ends": 'id,t\n1,"a\r\nb"\n2,c\r\n3,"d"\r\n',
    "text after quotes": 'id,t\n1,"a" b\n2,"c"d "e\n3,"f" ,\n4,"g" "h\n"i"",j\n5,"k\n"" l"\n',
    "quoted header": '"id","t\nx"\n1,"a,\nb"\n',
    "only a header": "id,t\n",
    "many stray quotes": "id,t\n" + "".join(f'{i},{"x" * (i % 7)}"{i}\n' if i % 3 else f'{i},"a\n{i}"""\n' for i in range(300)),
    "short and long rows": 'id,t\n1\n2,b,c\n,"\n"\n',
}


@pytest.mark.parametrize("name", TEXTS)
def test_split_follows_the_rules_of_the_parser(spark, tmp_path, split_bytes, name):
    with open(tmp_path / "t.csv", "w", newline="") as file:
        file.write(TEXTS[name])
    whole, split = (csv.read_csv(spark, str(tmp_path / "t.csv"), mode) for mode in ("whole", "split"))
    assert split.columns == whole.columns and values(split) == values(whole)
    if name == "stray quotes":
        assert [r[0] for r in values(split)] == ["1", "2", "3", "4", "5"]


def test_random_files_split_as_they_parse(spark, tmp_path, split_bytes):
    rng = random.Random(split_bytes)
    alphabet = ['"', '"', ",", "\n", "a", " ", '""', ',"', '"\n', "\n1,"]
    for i in range(6):
        body = "id,t\n" + "".join(rng.choice(alphabet) for _ in range(rng.randrange(150))) + "\n"
        path = tmp_path / f"{i}.csv"
        path.write_text(body)
        assert values(csv.read_csv(spark, str(path), "split")) == values(csv.read_csv(spark, str(path), "whole")), body


OPEN_ENDS = ['id,t\n1,"open\n2,b\n', 'id,t\n1,"open\n2,b', 'id,t\n1,a\n2,"', 'id,t\n1,"op""en\n\n\n', 'id,t\r\n1,"open\r\n2,b\r\n']
RETURNS = ["id,t\r1,a\r", 'id,t\r1,"a\nb"\r\r2,c\r3,"d\re"\r', 'id,t\r1,"open\r\n2,b\r', 'id,t\r1,a\r2,"b\r\nc"\r']


@pytest.mark.parametrize("text", [*OPEN_ENDS, *RETURNS])
def test_no_ending_is_refused(spark, tmp_path, split_bytes, text):
    (tmp_path / "t.csv").write_bytes(text.encode())
    whole, split = (values(csv.read_csv(spark, str(tmp_path / "t.csv"), mode)) for mode in ("whole", "split"))
    assert whole and split == whole


def test_an_open_end_over_many_splits(spark, tmp_path, split_bytes):
    (tmp_path / "a.csv").write_text('id,t\n1,x\n2,"' + "line\n" * 300)
    (tmp_path / "b.csv").write_bytes(b"id,t\r" + b'3,"u\rv"\r4,w\r' * 90)
    whole, split = (values(csv.read_csv(spark, str(tmp_path), mode)) for mode in ("whole", "split"))
    assert split == whole and len(whole) == 182


@pytest.fixture
def settings(spark):
    """Set settings of the session until the test ends."""
    before = {}

    def put(**values):
        for name, value in values.items():
            name = f"spark.sql.files.{name}"
            before.setdefault(name, spark.conf.get(name, None))
            spark.conf.set(name, value)

    yield put
    for name, value in before.items():
        spark.conf.unset(name) if value is None else spark.conf.set(name, value)


@pytest.mark.parametrize("later", [700, 333])
@pytest.mark.parametrize("first", [1 << 20, 900])
def test_a_later_change_of_split_sizes_moves_no_record(spark, tmp_path, settings, first, later):
    path = tmp_path / "t.csv"
    with open(path, "w", newline="") as file:
        writer = plain_csv.writer(file, lineterminator="\n")
        writer.writerows([("id", "t"), *[(i, f"a{i}\nb,{i}\n\nc" if i % 3 else f"plain {i}") for i in range(400)]])
    whole = values(csv.read_csv(spark, str(path), "whole"))
    settings(maxPartitionBytes=first, openCostInBytes=1, minPartitionNum=1)
    split = csv.read_csv(spark, str(path), "split")
    settings(maxPartitionBytes=later, minPartitionNum=64)
    assert values(split) == whole and len(whole) == 400


def test_both_scans_have_one_plan(spark, tmp_path, settings):
    (tmp_path / "t.csv").write_text("x" * 10_000)
    settings(maxPartitionBytes=1000, openCostInBytes=1)
    for partitions in (1, 500):
        settings(minPartitionNum=partitions)
        planned = split_csv.planned_session(spark).read.text(str(tmp_path / "t.csv"))
        assert planned.rdd.getNumPartitions() == 10
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    assert split_csv.planned_session(spark).conf.get("spark.sql.shuffle.partitions") == "3"
    spark.conf.set("spark.sql.shuffle.partitions", "8")


def test_a_range_that_was_not_planned_raises():
    file = split_csv._File(blocks=[0, 100], lengths=[100, 50], inside=[False, True])
    assert file.starts_inside(100, 50) and not file.starts_inside(0, 100)
    for block, length in ((50, 50), (0, 50), (100, 60)):
        with pytest.raises(ValueError, match="not one of the planned ranges"):
            file.starts_inside(block, length)


@pytest.mark.parametrize("mode", ["whole", "split", "lines"])
def test_another_header_in_the_folder_raises(spark, tmp_path, mode):
    (tmp_path / "a.csv").write_text("a,b\n1,x\n")
    (tmp_path / "b.csv").write_text("b,a\ny,2\n")
    with pytest.raises(Exception, match="header|Header"):
        csv.read_csv(spark, str(tmp_path), mode).collect()


def test_large_files_are_split(spark, tmp_path, monkeypatch, capsys):
    (tmp_path / "t.csv").write_text('id,text\n1,"a\nb"\n')

    def plan():
        df = csv.read_csv(spark, str(tmp_path))
        df.explain()
        return capsys.readouterr().out, df.drop("_seq").collect()

    whole, rows = plan()
    monkeypatch.setattr(csv, "WHOLE_FILE_LIMIT", 4)
    split, same_rows = plan()
    assert "FileScan csv" in whole and "FileScan parquet" in split and "/hirelake/records-" in split
    assert rows == same_rows == [("1", "a\nb")]


@pytest.mark.parametrize("mode", ["whole", "split", "lines"])
def test_rows_are_numbered_in_file_order(spark, tmp_path, mode):
    for part in range(3):
        (tmp_path / f"p{part}.csv").write_text("id\n" + "".join(f"{part * 100 + i}\n" for i in range(100)))
    df = csv.read_csv(spark, str(tmp_path), mode).repartition(4)
    ids = [int(r.id) for r in ordering.sequential_id(df, ["_seq"], ["n"]).orderBy("n").collect()]
    assert ids == list(range(300))


def test_numbered_rows_are_not_gone_through_again_for_the_numbers(spark, tmp_path, capsys):
    (tmp_path / "t.csv").write_text("id\n1\n2\n")
    numbered = ordering.sequential_id(csv.read_csv(spark, str(tmp_path / "t.csv")), ["_seq"], ["n"])
    capsys.readouterr()
    numbered.explain()
    assert capsys.readouterr().out.count("FileScan csv") == 1


def test_large_tables_are_copied_to_several_csv_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(layers, "CSV_FILE_ROWS", 10)
    paths = layers.write_csv_backup({"t": spark.range(0, 95, 1, 2)}, str(tmp_path))
    df = csv.read_csv(spark, paths["t"])
    assert len(df.inputFiles()) == 10
    assert [int(r.id) for r in ordering.sequential_id(df, ["_seq"], ["n"]).orderBy("n").collect()] == list(range(95))


def test_rows_taken_out_are_not_counted(spark, tmp_path):
    (tmp_path / "t.csv").write_text("id\n" + "".join(f"{i}\n" for i in range(50)))
    df = csv.read_csv(spark, str(tmp_path)).filter("id % 5 <> 0")
    numbered = ordering.sequential_id(df, ["_seq"], ["n"]).orderBy("n").collect()
    assert [(int(r.id), r.n) for r in numbered] == [(x, i + 1) for i, x in enumerate(i for i in range(50) if i % 5)]


def test_replacing_a_table_from_itself(spark, layer):
    assert layers.replace_table(spark.range(5), layer, "t") == 5
    own = layers.scan_table(spark, layer, "t")
    assert layers.replace_table(own.filter("id < 3"), layer, "T") == 3
    assert layers.scan_table(spark, layer, "t").count() == 3
    assert layers.replace_table(spark.range(2).withColumn("x", F.lit("new")), layer, "t") == 2
    assert layers.scan_table(spark, layer, "t").columns == ["id", "x"]
    assert layers.replace_table(spark.range(0), layer, "t") == 0
    assert layers.scan_table(spark, layer, "t").count() == 2
    assert [r.table_name for r in layers.list_tables(spark, layer).collect()] == ["t"]


def test_a_failed_write_leaves_the_table(spark, layer):
    layers.replace_table(spark.range(4), layer, "t")
    broken = spark.range(4).select(F.raise_error(F.lit("no")).cast("bigint").alias("id"))
    with pytest.raises(Exception):
        layers.replace_table(broken, layer, "t")
    assert layers.scan_table(spark, layer, "t").count() == 4


def test_a_failed_change_of_columns_leaves_the_table(spark, layer, monkeypatch):
    layers.replace_table(spark.range(4), layer, "t")

    class Failing:
        def __getattr__(self, name):
            return getattr(spark, name)

        def sql(self, text):
            raise RuntimeError("catalog is away")

    changed = spark.range(9).withColumn("x", F.lit(1))
    monkeypatch.setattr(type(changed), "sparkSession", property(lambda self: Failing()))
    with pytest.raises(RuntimeError):
        layers.replace_table(changed, layer, "t")
    monkeypatch.undo()
    assert layers.scan_table(spark, layer, "t").columns == ["id"] and layers.scan_table(spark, layer, "t").count() == 4


def test_earlier_contents_can_be_removed(spark, layer, tmp_path):
    for n in (2, 3, 4):
        layers.replace_table(spark.range(n), layer, "T")
    layers.replace_table(spark.range(0), layer, "t")
    assert len(list((tmp_path / layer / "t").iterdir())) == 3
    assert len(layers.vacuum(spark, layer, "t")) == 2
    assert len(list((tmp_path / layer / "t").iterdir())) == 1 and layers.scan_table(spark, layer, "t").count() == 4


def contents(spark, layer, *tables):
    return [[r.id for r in layers.scan_table(spark, layer, t).orderBy("id").collect()] for t in tables]


def test_tables_of_a_commit_change_together(spark, layer):
    layers.replace_tables({"a": spark.range(2), "b": spark.range(3)}, layer)
    with pytest.raises(RuntimeError, match="between"):
        with layers.Commit(spark, layer) as commit:
            assert commit.store(spark.range(5), "a") == 5 and commit.table("a").count() == 5
            assert contents(spark, layer, "a") == [[0, 1]]
            raise RuntimeError("between two tables")
    assert contents(spark, layer, "a", "b") == [[0, 1], [0, 1, 2]]
    broken = spark.range(4).select(F.raise_error(F.lit("no")).cast("bigint").alias("id"))
    with pytest.raises(Exception):
        layers.replace_tables({"a": spark.range(7), "b": broken}, layer)
    assert contents(spark, layer, "a", "b") == [[0, 1], [0, 1, 2]]
    assert versions.version(spark, layer).number == 1 and layers.vacuum(spark, layer) == []
    layers.replace_tables({"a": spark.range(1), "b": spark.range(1)}, layer)
    assert contents(spark, layer, "a", "b") == [[0], [0]]
    found = layers.history(spark, layer).orderBy("version", "table_name").collect()
    assert [(r.version, r.table_name, r.row_count) for r in found] == [(1, "a", 2), (1, "b", 3), (2, "a", 1), (2, "b", 1)]


def test_the_log_alone_switches_all_views(spark, layer, monkeypatch):
    layers.replace_tables({"a": spark.range(2), "b": spark.range(3)}, layer)

    def fail(*_):
        raise RuntimeError("away")

    monkeypatch.setattr(versions.Commit, "_log", fail)
    with pytest.raises(RuntimeError):
        layers.replace_tables({"a": spark.range(4), "b": spark.range(4)}, layer)
    monkeypatch.undo()
    # The views were made to show either content, and the log has the old one.
    assert versions.follow(spark, layer) == ["a", "b"]
    assert contents(spark, layer, "a", "b") == [[0, 1], [0, 1, 2]]

    monkeypatch.setattr(versions, "_show", fail)
    with pytest.raises(RuntimeError):
        layers.replace_tables({"a": spark.range(4), "b": spark.range(5)}, layer)
    monkeypatch.undo()
    assert contents(spark, layer, "a", "b") == [[0, 1, 2, 3], [0, 1, 2, 3, 4]]
    assert versions.follow(spark, layer) == ["a", "b"] and versions.follow(spark, layer) == []
    assert contents(spark, layer, "a", "b") == [[0, 1, 2, 3], [0, 1, 2, 3, 4]]


def test_views_show_the_old_rows_until_the_log_has_the_new_version(spark, layer, monkeypatch):
    layers.replace_tables({"a": spark.range(2), "b": spark.range(3)}, layer)
    seen, log = [], versions.Commit._log

    def watched(self, *args):
        seen.append(contents(spark, layer, "a", "b"))
        logged = log(self, *args)
        seen.append(contents(spark, layer, "a", "b"))
        return logged

    monkeypatch.setattr(versions.Commit, "_log", watched)
    layers.replace_tables({"a": spark.range(1), "b": spark.range(1)}, layer)
    assert seen == [[[0, 1], [0, 1, 2]], [[0], [0]]]


def test_vacuum_leaves_open_writes_and_young_versions(spark, layer, tmp_path):
    folder = tmp_path / layer / "t"
    layers.replace_table(spark.range(1), layer, "t")
    with layers.Commit(spark, layer) as commit:
        commit.store(spark.range(2), "t")
        assert layers.vacuum(spark, layer, "t") == [] and len(list(folder.iterdir())) == 2
    assert contents(spark, layer, "t") == [[0, 1]]
    assert layers.vacuum(spark, layer, "t", age=3600) == [] and len(list(folder.iterdir())) == 2
    assert len(layers.vacuum(spark, layer, "t")) == 1 and contents(spark, layer, "t") == [[0, 1]]

    left = layers.Commit(spark, layer)
    left.store(spark.range(3), "t")
    left.store(spark.range(3), "new")
    assert layers.vacuum(spark, layer) == []
    assert len(layers.vacuum(spark, layer, abandoned=-1)) == 2 and contents(spark, layer, "t") == [[0, 1]]
    assert list((tmp_path / layer / "open.log").glob("[!.]*")) == []


def test_a_commit_gives_way_to_one_that_came_before(spark, layer):
    layers.replace_table(spark.range(1), layer, "t")
    first, second, other = (layers.Commit(spark, layer) for _ in range(3))
    for commit, table, rows in ((first, "t", 2), (second, "t", 3), (other, "u", 4)):
        commit.store(spark.range(rows), table)
    first.__exit__(None, None, None)
    with pytest.raises(versions.Conflict):
        second.__exit__(None, None, None)
    other.__exit__(None, None, None)
    assert contents(spark, layer, "t", "u") == [[0, 1], [0, 1, 2, 3]] and versions.version(spark, layer).number == 3


def test_side_by_side_replacements_all_arrive(spark, layer):
    counts = layers.side_by_side({f"t{i}": i + 1 for i in range(6)}, lambda t, n: layers.replace_table(spark.range(n), layer, t))
    assert counts == {f"t{i}": i + 1 for i in range(6)}
    assert versions.numbers(spark, layer) == [1, 2, 3, 4, 5, 6]
    assert [len(c) for c in contents(spark, layer, *counts)] == list(counts.values())


def test_rows_are_counted_while_they_are_written(spark, layer, monkeypatch):
    monkeypatch.setattr(versions, "Observation", lambda: type("Wrong", (), {"get": {"rows": 3}})())
    monkeypatch.setattr("pyspark.sql.DataFrame.observe", lambda df, *_: df, raising=False)
    monkeypatch.setattr(type(spark.range(1)), "observe", lambda df, *_: df)
    with pytest.raises(ValueError, match="4 rows instead of 3"):
        layers.replace_table(spark.range(4), layer, "t")
    assert not layers.table_exists(spark, layer, "t")


def test_runs_are_recorded_one_after_another(spark, layer):
    assert layers.run_history(spark, layer).count() == 0
    for run, rows in (("r1", 3), ("r2", 4)):
        layers.record_run(layers.run_manifest(spark, run, {"t": rows}, {"t": f"/{run}"} if rows == 4 else {}), layer)
    found = layers.run_history(spark, layer).orderBy("run_id").collect()
    assert [tuple(r)[:4] for r in found] == [("r1", "t", 3, None), ("r2", "t", 4, "/r2")] and found[0].recorded_at


@pytest.mark.parametrize("copy, name", [(layers.write_parquet_run, "runs/r1/t_cleaned.parquet"), (layers.write_csv_backup, "runs/r1/t.csv")])
def test_a_copy_that_fails_leaves_the_earlier_one(spark, tmp_path, copy, name):
    where = (str(tmp_path / "runs"), "r1") if copy is layers.write_parquet_run else (str(tmp_path / "runs/r1"),)
    copy({"t": spark.range(3)}, *where)
    before = sorted((tmp_path / name).iterdir())
    broken = spark.range(4).select(F.when(F.col("id") < 3, F.col("id")).otherwise(F.raise_error(F.lit("no")).cast("bigint")).alias("id"))
    with pytest.raises(Exception):
        copy({"t": broken}, *where)
    assert sorted((tmp_path / name).iterdir()) == before and (tmp_path / name / "_SUCCESS").exists()
    copy({"t": spark.range(5)}, *where)
    assert sorted((tmp_path / name).iterdir()) != before
    assert [p.name for p in (tmp_path / name).parent.iterdir()] == [name.rsplit("/", 1)[-1]]


def test_staged_tables_of_a_scope_are_removed(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(staging, "fresh_path", lambda s, label: str(tmp_path / label))
    with staging.releasing(spark):
        layers.side_by_side({"a": 1, "b": 2}, lambda name, n: staging.stage(spark.range(n), name).count())
        assert (tmp_path / "a").exists() and (tmp_path / "b").exists()
    assert not (tmp_path / "a").exists() and not (tmp_path / "b").exists()
    assert staging.stage(spark.range(3), "c").count() == 3 and (tmp_path / "c").exists()


def test_row_count_check(spark, layer):
    layers.replace_table(spark.range(4), layer, "t")
    assert layers.rowcount_validate(spark, layer, "t", 4) == 4
    with pytest.raises(ValueError):
        layers.rowcount_validate(spark, layer, "t", 5)


def test_gate_states(spark, layer):
    def gate(name=layer):
        return layers.needs_refresh(spark, name, ["a", "b"])

    assert gate(f"{layer}_absent")
    assert gate()
    layers.replace_table(spark.range(1), layer, "a")
    assert gate()
    layers.replace_table(spark.range(0), layer, "b", skip_empty=False)
    assert gate()
    layers.replace_table(spark.range(1), layer, "b")
    assert not gate()
    assert layers.needs_cleaning(spark, layer) and "skills_industries" not in CLEANED_TABLES


def test_a_gate_must_answer():
    assert layers.run_if_needed(True, lambda: 7) == 7
    assert layers.run_if_needed(False, lambda: 7) is None
    with pytest.raises(ValueError):
        layers.run_if_needed(None, lambda: 7)


def test_contracts(spark):
    df = spark.createDataFrame([(1, 2)], "a int, b int")
    assert layers.require_columns(df, ["a"]) is df
    with pytest.raises(KeyError):
        layers.require_columns(df, ["a", "name"])
    with pytest.raises(ValueError):
        layers.require_nonempty(df.filter("false"))
    with pytest.raises(ValueError):
        layers.assert_unique(df.union(df), ["a"])
    assert layers.default_empty_table(df, "x int") is df
    assert layers.default_empty_table(None, "x int", spark).columns == ["x"]


def test_empty_tables_are_not_copied(spark, tmp_path):
    tables = {"full": spark.range(3), "empty": spark.range(0)}
    assert list(layers.write_parquet_run(tables, str(tmp_path / "runs"), "r1")) == ["full"]
    assert (tmp_path / "runs/r1/full_cleaned.parquet").exists()
    assert list(layers.write_csv_backup(tables, str(tmp_path / "backup"))) == ["full"]


def test_a_frequent_key_spans_several_files(spark):
    df = spark.range(9000).select(F.when(F.col("id") % 3 == 0, 5).otherwise(F.col("id")).alias("k"), "id")
    laid_out = layers.layout_by_key(df, ["k"], 9)
    sizes = [r["count"] for r in laid_out.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 9000 and max(sizes) < 2200


def test_interleaved_keys_let_filters_on_either_skip_files(spark, layer):
    rows = spark.range(20_000).select(
        (F.col("id") * 7919 % 20_011).alias("a"),
        F.when(F.col("id") % 50 == 0, None).otherwise(F.date_add(F.lit("2024-01-01").cast("date"), (F.col("id") * 104_729 % 997).cast("int"))).alias("d"),
        F.concat(F.lit("name "), F.lpad((F.col("id") * 31 % 9973).cast("string"), 5, "0")).alias("s"),
    )
    for keys in (["a", "d"], ["a", "s"], ["s", "d", "a"]):
        layers.replace_table(layers.layout_by_key(rows, keys, 64), layer, "t")
        table = layers.scan_table(spark, layer, "t")
        assert table.count() == 20_000 and table.columns == rows.columns
        for key in keys:
            low, high = table.agg(F.percentile(F.col(key), 0.5) if key == "a" else F.max(key), F.max(key)).first()
            low = high if key != "a" else low
            files, of = layers.files_read(table, key, F.lit(low), F.lit(low)).first()
            assert of >= 56 and files <= 3 * of ** (1 - 1 / len(keys)), (keys, key, files, of)


def test_a_key_of_a_third_of_the_rows_is_spread_by_interleaving_too(spark):
    df = spark.range(9000).select(F.when(F.col("id") % 3 == 0, 5).otherwise(F.col("id")).alias("k"), (F.col("id") % 2).alias("m"), "id")
    sizes = [r["count"] for r in layers.layout_by_key(df, ["k", "m"], 9).groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 9000 and max(sizes) < 2200
