"""Recordings in folders and archives, reports."""

import json
import zipfile

import numpy as np
import pytest

from pulsespark.sources import recordings, tables


def csv(n, fs=125, ecg=True, resp=False):
    head = "Time,PPG" + (",ECG" if ecg else "") + (",resp" if resp else "")
    return head + "\n" + "\n".join(",".join(map(str, [k / fs, k % 7, *([k % 5] if ecg else []), *([k % 3] if resp else [])])) for k in range(n))


@pytest.fixture
def contact(tmp_path):
    with zipfile.ZipFile(tmp_path / "mimic_perform_af_csv.zip", "w") as z:
        z.writestr("a/mimic_perform_af_001_data.csv", csv(50))
        z.writestr("a/mimic_perform_af_002_data.csv", csv(20, fs=30, ecg=False))
        z.writestr("a/readme.txt", "x")
    (tmp_path / "loose").mkdir()
    (tmp_path / "loose/mimic_perform_non_af_001_data.csv").write_text(csv(30, resp=True))
    (tmp_path / "loose/mimic_perform_af_001_data.csv").write_text(csv(3))  # the archive's comes first
    with zipfile.ZipFile(tmp_path / "mimic_perform_test_all_csv.zip", "w") as z:
        for k, g in ((1, "a"), (2, "n"), (3, None)):
            z.writestr(f"mimic_perform_test_all_{k}_data.csv", csv(10 * k))
            if g:
                z.writestr(f"mimic_perform_test_all_{k}_fix.txt", f"Group: {g}\nother")
    return str(tmp_path)


def test_members_of_archives_are_partitions(spark, contact):
    df = recordings.read(spark, "contact_af", contact)
    assert df.rdd.getNumPartitions() == 3
    got = {r["rec"]: r for r in df.groupBy("rec", "af", "fs").agg({"i": "max", "ecg": "count", "resp": "count", "ppg": "sum"}).collect()}
    assert {k: (r["af"], r["fs"], r["max(i)"] + 1, r["count(ecg)"], r["count(resp)"]) for k, r in got.items()} == {"af_001": (True, 125.0, 50, 50, 0), "af_002": (True, 30.0, 20, 0, 0), "non_af_001": (False, 125.0, 30, 30, 30)}
    assert got["af_002"]["sum(ppg)"] == sum(k % 7 for k in range(20))


def test_groups_prune_recordings(spark, contact):
    df = recordings.read(spark, "contact_testing", contact)
    assert df.rdd.getNumPartitions() == 3
    adults = df.where("grp = 'a'")
    assert adults.rdd.getNumPartitions() == 1 and adults.count() == 10
    assert df.where("rec IN ('test_all_2', 'test_all_3')").rdd.getNumPartitions() == 2
    assert recordings.read(spark, "contact_af", contact).where("af AND i > 45").count() == 4
    assert recordings.read(spark, "contact_af", contact).where("af = false").count() == 30


def test_annotations_carry_their_rhythm_forward(spark, tmp_path):
    text = "Time Sample Type Sub Chan Num\tAux\n" + "\n".join(["0:00 18 + 0 0 0\t(N", "0:01 77 N 0 0 0", "0:02 370 V 0 0 0", "bad", "0:03 400 + 0 0 0\t(AFIB", "0:04 662 N 0 0 0", "0:05 700 ~ 0 0 0", "0:06 800 + 0 0 0\tMISSB", "0:07 946 A 0 0 0", "0:08 950 + 0 0 0\t(N", "0:09 1000 N 0 0 0"])
    (tmp_path / "100annotations.txt").write_text(text)
    (tmp_path / "102annotations.txt").write_text(text)
    with zipfile.ZipFile(tmp_path / "x.zip", "w") as z:
        z.writestr("d/201annotations.txt", text.replace("(AFIB", "(AFL"))
    got = [(r["symbol"], r["in_af"]) for r in recordings.read(spark, "annotations", str(tmp_path)).where("rec = '100'").orderBy("t").collect()]
    assert got == [("N", False), ("V", False), ("N", True), ("A", True), ("N", False)]
    all_of = recordings.read(spark, "annotations", str(tmp_path))
    assert {r["rec"] for r in all_of.collect()} == {"100", "201"} and all_of.where("rec = '201' AND in_af").count() == 2
    assert recordings.read(spark, "annotations", str(tmp_path), paced="true").select("rec").distinct().count() == 3
    assert all_of.where("t BETWEEN 1 AND 2").first()["t"] == 370 / 360


def test_faces(spark, tmp_path):
    for k in (1, 2, 10):
        d = tmp_path / "two" / f"subject{k}"
        d.mkdir(parents=True)
        (d / "ground_truth.txt").write_text("1 2 3\n70 70 70\n" + ("0 0.1 0.2" if k > 1 else "0 0.1"))
        if k < 10:
            (d / "vid.avi").write_bytes(b"")
    rows = recordings.read(spark, "face_lines", str(tmp_path / "two")).collect()
    assert {(r["rec"], r["subject"]) for r in rows} == {("subject1", "1"), ("subject2", "2")}
    assert [r["t"] for r in rows if r["rec"] == "subject1"] == [None] * 3 and [r["t"] for r in rows if r["rec"] == "subject2"] == [0.0, 0.1, 0.2]
    d = tmp_path / "one" / "5-gt"
    d.mkdir(parents=True)
    (d / "gtdump.xmp").write_text("100,70,98,5\n116,70,98,6\n")
    (d / "vid.avi").write_bytes(b"")
    assert [(r["rec"], r["t"], r["ppg"]) for r in recordings.read(spark, "face_rows", str(tmp_path / "one")).collect()] == [("ubfc1_5-gt", 0.0, 5.0), ("ubfc1_5-gt", 0.016, 6.0)]
    for name, images in (("01-02", [1_000_000_000, 1_033_000_000]), ("03-01", [])):
        d = tmp_path / "json" / name / name
        d.mkdir(parents=True)
        for t in (2_000_000_000, 2_033_000_000):
            (d / f"Image{t}.png").write_bytes(b"")
        (d.parent / f"{name}.json").write_text(json.dumps({"/FullPackage": [{"Timestamp": 2_500_000_000, "Value": {"waveform": 4}}], "/Image": [{"Timestamp": t} for t in images]}))
    got = {r["rec"]: (r["subject"], r["session"], r["t"], r["ppg"]) for r in recordings.read(spark, "face_json", str(tmp_path / "json")).collect()}
    assert got == {"01-02": ("01", "02", 1.5, 4.0), "03-01": ("03", "01", 0.5, 4.0)}


def test_parts_of_archives(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "p1.zip", "w") as z:
        for n in ("DATASET_2/subject1/vid.avi", "DATASET_2/subject2/vid.avi", "DATASET_1/5-gt/gtdump.xmp", "deep/a/b/c.avi"):
            z.writestr(n, "x")
    with zipfile.ZipFile(tmp_path / "p2.zip", "w") as z:
        for n in ("DATASET_2/subject1/ground_truth.txt", "DATASET_1/5-gt/vid.avi", "DATASET_2/subject1/vid.avi"):
            z.writestr(n, "x")
    got = {(r["dataset"], r["subject"]): (r["zip"][-6:], r["truth"] and r["truth"].split("/")[-1], r["folder"]) for r in recordings.matched_parts(recordings.read(spark, "archives", str(tmp_path))).collect()}
    assert got == {("DATASET_2", "subject1"): ("p1.zip", "ground_truth.txt", "ubfc"), ("DATASET_2", "subject2"): ("p1.zip", None, "noref"), ("DATASET_1", "5-gt"): ("p2.zip", "gtdump.xmp", "ubfc1")}


def test_records_are_written_once(spark, tmp_path):
    out = str(tmp_path / "out")
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("b", 3.0)], "rec string, v double")
    recordings.write_new(df.where("rec = 'a'"), out)
    recordings.write_new(df, out)
    recordings.write_new(df, out)
    assert sorted((r["rec"], r["v"]) for r in spark.read.parquet(out).collect()) == [("a", 1.0), ("a", 2.0), ("b", 3.0)]


def test_unknown_form_and_empty_folder(spark, tmp_path):
    with pytest.raises(Exception, match="form must be one of"):
        recordings.read(spark, "other", str(tmp_path))
    assert recordings.read(spark, "contact_af", str(tmp_path / "none")).count() == 0


def test_reports_and_text_readers(spark, tmp_path):
    report = spark.createDataFrame([("x", 1.23456, 3), (None, None, 4)], "name string, v double, n int")
    tables.write_report(report, str(tmp_path / "r"), "csv")
    assert spark.read.csv(str(tmp_path / "r"), header=True).count() == 2
    assert [r["line"] for r in tables.markdown(report, 2).collect()] == ["| x | 1.23 | 3 |", "|  |  | 4 |"]
    (tmp_path / "a.csv").write_text("5,70,98,1.5\n21,71,98,2.5\n")
    assert [(r["rec"], r["t"], r["ppg"]) for r in tables.read_waveform_csv(spark, str(tmp_path / "a.csv")).orderBy("t").collect()] == [("a", 0.0, 1.5), ("a", 0.016, 2.5)]
    (tmp_path / "b.txt").write_text("1 2\n70 70\n0.0 0.5")
    assert [(r["rec"], r["i"], r["ppg"], r["t"]) for r in tables.read_waveform_lines(spark, str(tmp_path / "b.txt")).orderBy("i").collect()] == [("b", 0, 1.0, 0.0), ("b", 1, 2.0, 0.5)]
    (tmp_path / "c.txt").write_text("0:00 18 + 0 0 0 (N\n0:01 77 N 0 0 0\n")
    assert [(r["rec"], r["beat"], r["symbol"], r["aux"]) for r in tables.read_annotations(spark, str(tmp_path / "c.txt")).orderBy("beat").collect()] == [("c", 18, "+", "(N"), ("c", 77, "N", None)]
    assert np.isclose(tables.read_annotations(spark, str(tmp_path / "c.txt")).where("beat = 77").first()["t"], 77 / 360)
