"""Readers, discovery, sinks and artefacts."""

import json

import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from baitlens.operators import drift as dr
from baitlens.operators.dedup import union_by_name
from baitlens.operators.profile import fit_profile
from baitlens.operators.schema import standardise_columns, synthesise_text
from baitlens.plans.config import EvaluationConfig, TrainingConfig
from baitlens.plans.stages import Cleaning, SpecFeatures, TextSignals, UrlFeatures
from baitlens.sources import readers as rd
from baitlens.sources import writers as wr


def test_csv_lines(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text('label,text\n1,"two\nlines"\n0,plain\n1,too,many,fields\n0\n1,"say ""hi"""\n', encoding="utf-8")
    rows = [(r["label"], r["text"]) for r in rd.read_any(spark, str(path)).collect()]
    assert rows == [("1", "two\nlines"), ("0", "plain"), ("0", None), ("1", 'say "hi"')]


def test_encoding_fallback(spark, tmp_path):
    (tmp_path / "l.csv").write_bytes("label,text\n1,café\n".encode("latin-1"))
    (tmp_path / "u.csv").write_bytes("label,text\n1,café\n".encode("utf-8"))
    assert rd.text_encoding(spark, str(tmp_path / "l.csv")) == rd.FALLBACK_ENCODING
    for name in ("l.csv", "u.csv"):
        assert rd.read_csv(spark, str(tmp_path / name)).first()["text"] == "café"


def test_json_and_corpus(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"a": 1}\nnot json\n{"a": 2}\n')
    assert sorted(r["a"] for r in rd.read_any(spark, str(tmp_path / "a.jsonl")).collect()) == [1, 2]
    (tmp_path / "b.json").write_text(json.dumps([{"a": 1}, {"a": 2}, {"a": 3}], indent=2))
    assert rd.read_any(spark, str(tmp_path / "b.json")).count() == 3
    (tmp_path / "SMSSpamCollection").write_text("ham\thello there\nspam\twin now\n")
    assert [tuple(r) for r in rd.read_any(spark, str(tmp_path / "SMSSpamCollection")).collect()] == [
        ("ham", "hello there"), ("spam", "win now")]
    with pytest.raises(ValueError):
        rd.read_any(spark, "x.xlsx")


def test_discover_and_ingest(spark, tmp_path, monkeypatch):
    (tmp_path / "deep").mkdir()
    (tmp_path / "deep" / "a.csv").write_text("Unnamed: 0,Email Type,Email Text,date\n0,Phishing Email,hello,2024-01-01\n")
    (tmp_path / "deep" / "b.tsv").write_text("v1\tv2\nham\thi\n")
    (tmp_path / "c.json").write_text('[{"class": 1, "subject": "s", "url": "u"}]')
    (tmp_path / "notes.txt").write_text("no")
    monkeypatch.setenv("DATA_DIR", str(tmp_path / "deep"))
    paths = rd.discover(spark, [str(tmp_path), str(tmp_path / "absent")])
    assert [p.rsplit("/", 1)[-1] for p in paths] == ["a.csv", "b.tsv", "c.json"]
    found = rd.ingest(spark, [*paths, paths[0], str(tmp_path / "gone.csv")])
    assert list(found.skipped) == [str(tmp_path / "gone.csv")] and len(found.used) == 3
    rows = {r["text"]: r for r in found.table.collect()}
    assert rows["hello"]["label"] == "Phishing Email" and rows["hello"]["timestamp"] == "2024-01-01"
    assert rows["hi"]["label"] == "ham" and rows["s u"]["label"] == "1" and rows["s u"]["url"] == "u"
    assert rd.ingest(spark, ["/absent.csv"]).table is None


def test_alias_order(spark):
    df = standardise_columns(spark.createDataFrame([("t", "b", "x")], "title string, body string, result string"))
    assert df.columns == ["title", "text", "label"]
    assert synthesise_text(spark.createDataFrame([("a", None, 1)], "p string, q string, n int")).first()["text"] == "a "
    both = union_by_name(spark.createDataFrame([(1,)], "a int"), spark.createDataFrame([(2,)], "b int"))
    assert sorted(both.columns) == ["a", "b"] and both.count() == 2


def test_splits_reused_unless_forced(spark, tmp_path):
    path = str(tmp_path / "splits")
    first = spark.createDataFrame([(1, "train")], "id int, split string")
    second = spark.createDataFrame([(2, "val"), (3, "test")], "id int, split string")
    assert wr.existing_or_prepare(spark, path, lambda: first).count() == 1
    assert wr.existing_or_prepare(spark, path, lambda: second).count() == 1
    assert wr.existing_or_prepare(spark, path, lambda: second, force=True).count() == 2
    wr.write_splits(second, str(tmp_path / "csv"), fmt="csv")
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).where("split = 'val'").first()["id"] == "2"


def test_manifest(tmp_path):
    path = str(tmp_path / "m.json")
    wr.Manifest("a.csv", "b.csv", "c.csv", "y").save(path)
    assert wr.Manifest.load(path) == wr.Manifest("a.csv", "b.csv", "c.csv", "y")


def test_baseline_and_history(spark, tmp_path):
    df = spark.createDataFrame([(float(i), i % 2) for i in range(20)], "x double, y int")
    wr.save_baseline(dr.establish_baseline(df, ["x"]), str(tmp_path / "base"))
    baseline = wr.load_baseline(spark, str(tmp_path / "base"))
    assert baseline.first()["counts"] == dr.establish_baseline(df, ["x"]).first()["counts"]
    path = str(tmp_path / "history")
    for factor in (1.0, 0.1):
        moved = df.withColumn("x", F.col("x") * factor)
        wr.append_history(dr.drift_report(baseline, moved, dr.label_shares(df, "y"), "y"), path)
    history = wr.read_history(spark, path)
    assert history.count() == 2 and dr.history_tail(history, keep=1).count() == 1
    last = dr.last_record(history).first()
    assert last["alert_triggered"] and last["drifted_features"] == ["x"] and last["feature_drift"] == []


def test_diagnostics_and_scored_file(spark, tmp_path):
    rows = [(i, "g1" if i < 6 else "g2", i % 2, 0.9 if i % 3 else 0.1) for i in range(10)]
    scored = spark.createDataFrame(rows, "id int, g string, label int, score double")
    wr.write_diagnostics(scored, str(tmp_path / "d"), "g", "id", head=2)
    heads = {k: spark.read.option("header", True).csv(str(tmp_path / "d" / f"{k}_head")).count() for k in ("FP", "FN")}
    assert heads == {"FP": 2, "FN": 2}
    assert spark.read.option("header", True).csv(str(tmp_path / "d" / "group_stats")).first()["g"] == "g1"
    (tmp_path / "urls.csv").write_text("url\nhttp://a.com\n")
    target = wr.score_file(spark, str(tmp_path / "urls.csv"), lambda df: df.withColumn("score", F.lit(0.5)))
    assert target.endswith("urls_predictions") and spark.read.option("header", True).csv(target).first()["score"] == "0.5"


def test_stages_and_artifacts(spark, tmp_path):
    df = spark.createDataFrame([(i, f"http://a{i}.com/{'x' * i}", "dear bob") for i in range(12)], "id int, url string, text string")
    made = TextSignals(inputCol="text").transform(UrlFeatures(inputCol="url", advanced=True).transform(df))
    cleaning = Cleaning(columns=["url_length", "path_length"]).fit(made)
    model = PipelineModel([UrlFeatures(inputCol="url"), cleaning])
    profile = fit_profile(made, ["url_length", "path_length"])
    wr.save_artifacts(str(tmp_path / "art"), model, profile, {"best_threshold": 0.7}, {"rows": df}, spark)
    loaded = wr.load_artifacts(spark, str(tmp_path / "art"))
    assert loaded.threshold == 0.7 and loaded.abstain_band == 0.05 and loaded.profile == profile
    before = model.transform(df).orderBy("id").collect()
    assert loaded.model.transform(df).orderBy("id").collect() == before
    assert spark.read.parquet(str(tmp_path / "art" / "tables" / "rows")).count() == 12
    assert "url_len" in SpecFeatures().transform(df).columns
    assert SpecFeatures(specs='[{"name": "n", "type": "len", "source": "url"}]', mode="replace").transform(df).columns == ["n"]


def test_configuration(monkeypatch):
    monkeypatch.setenv("OPERATING_POINT", "precision")
    monkeypatch.setenv("USE_SMOTE", "no")
    monkeypatch.setenv("SVD_COMPONENTS", "many")
    config = TrainingConfig.from_environment(cost_fn=9.0)
    assert (config.operating_point, config.use_smote, config.svd_components, config.cost_fn) == ("precision", False, 512, 9.0)
    shared = EvaluationConfig(target_fpr=0.01).to_training(use_svd=False)
    assert shared.target_fpr == 0.01 and shared.use_svd is False and shared.calibration_method == "isotonic"


def test_ingest_job_keeps_the_first_source_and_stores_splits(spark, tmp_path):
    from baitlens.plans.ingest import ingest_to_splits, prepared_rows

    spark.createDataFrame([("spam", "same text"), ("ham", None), ("what", "x"), ("ham", "  ")], "label string, text string").write.parquet(f"{tmp_path}/a.parquet")
    spark.createDataFrame([("ham", "same text"), ("ham", "own text")], "label string, text string").write.json(f"{tmp_path}/b.jsonl")
    job = ingest_to_splits(spark, [f"{tmp_path}/a.parquet", f"{tmp_path}/b.jsonl", f"{tmp_path}/none.parquet"], f"{tmp_path}/out")
    rows = {r["text"]: r for r in job.table.collect()}
    assert {t: r["label"] for t, r in rows.items()} == {"same text": 1, "own text": 0}
    assert sorted(r["row_id"] for r in rows.values()) == [1, 2] and len(job.skipped) == 1
    assert all(r["timestamp"] is not None and r["split"] in ("train", "val", "test") for r in rows.values())
    nothing = spark.createDataFrame([], "label int, text string, url string, timestamp timestamp_ntz, source_place long")
    assert prepared_rows(nothing).count() == 0


def test_only_unreadable_content_is_skipped(spark, tmp_path, monkeypatch):
    (tmp_path / "good.csv").write_text("label,text\n1,hello\n")
    (tmp_path / "broken.parquet").write_bytes(b"this is no parquet file")
    (tmp_path / "odd.xyz").write_text("x")
    paths = [str(tmp_path / n) for n in ("good.csv", "broken.parquet", "odd.xyz", "gone.csv")]
    found = rd.ingest(spark, paths)
    assert found.used == paths[:1] and found.table.count() == 1
    assert found.skipped[paths[2]] == "NO_READER" and found.skipped[paths[3]] == "PATH_NOT_FOUND"
    assert found.skipped[paths[1]].split(".")[0] in rd.UNREADABLE

    def fails(*_):
        raise RuntimeError("an executor was lost")

    monkeypatch.setattr(rd, "read_any", fails)
    with pytest.raises(RuntimeError):
        rd.ingest(spark, paths[:1])


def test_json_documents_grow_in_number(spark, tmp_path, monkeypatch):
    import json

    from baitlens.sources import writers as wr

    rows = [(i, f"line {i}\n, [\"x\"]" if i % 3 else None) for i in range(40)]
    df = spark.createDataFrame(rows, "id long, text string")
    monkeypatch.setattr(wr, "FILE_BYTES", 200)
    folder = wr.write_json_documents(df, str(tmp_path / "a.json"), 2)
    files = [f for f in (tmp_path / "a.json").iterdir() if f.suffix == ".txt"]
    assert len(files) > 2
    found = [r for f in files for r in json.loads(f.read_text())]
    assert sorted((r["id"], r.get("text")) for r in found) == rows
    nothing = wr.write_json_documents(df.limit(0), str(tmp_path / "b.json"), 2)
    assert spark.read.option("multiLine", True).schema("id long").json(nothing).count() == 0
    assert sorted(map(tuple, spark.read.option("multiLine", True).schema("id long, text string").json(folder).collect())) == rows
