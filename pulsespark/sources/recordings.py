"""Recordings in folders and zip archives as a Spark data source: `spark.read.format("recordings")`.

A partition is one recording: a member of an archive or a loose file, so archives are read by as many tasks as they have
recordings, each reading its own bytes. Filters on `rec`, `grp` and `dataset` prune recordings before any is
opened (with spark.sql.python.filterPushdown.enabled). Paths are local or of any store that pyarrow knows.

Options: path; form, one of LAYOUTS; paced ("true" keeps paced records of "annotations").
"""

from __future__ import annotations

import io
import json
import re
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualNullSafe, EqualTo, Filter, In, InputPartition

WAVES = "dataset string, rec string, subject string, grp string, af boolean, session string, fs double, i long, t double, ppg double, ecg double, resp double"
BEATS = "rec string, beat long, t double, symbol string, in_af boolean"
PARTS = "zip string, dataset string, subject string, member string, kind string, size long"

# fixed values: the usual beat symbols, rhythms of fibrillation or flutter, and records with paced beats
BEAT_SYMBOLS = frozenset("NLRBAaJSVrFejnE/fQ?")
AF_RHYTHMS = ("(AFIB", "(AFL")
PACED = frozenset(["102", "104", "107", "217"])
ANNOTATION_FS = 360.0
TRUTHS = ("ground_truth.txt", "gtdump.xmp")


@dataclass
class Recording(InputPartition):
    """Where a recording lies: a file, or a member of an archive, and what its name says of it."""

    rec: str
    path: str
    member: str | None = None
    side: str | None = None  # a second file (description or list of frames)
    dataset: str = ""
    subject: str = ""
    grp: str = ""
    af: bool | None = None
    session: str | None = None


class Store:
    """Files below a path."""

    def __init__(self, path: str):
        self.fs, self.root = pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)

    def files(self) -> list[str]:
        found = self.fs.get_file_info(pafs.FileSelector(self.root, recursive=True, allow_not_found=True))
        return sorted(f.path for f in found if f.type == pafs.FileType.File)

    def open(self, path: str):
        return self.fs.open_input_file(path)

    def bytes(self, r: Recording, what: str | None = None) -> bytes:
        """The recording, or its second file."""
        name = what or r.member
        if r.member:
            with self.open(r.path) as f, zipfile.ZipFile(f) as z:
                return z.read(name)
        with self.open(what or r.path) as f:
            return f.read()

    def members(self, path: str) -> list[zipfile.ZipInfo]:
        with self.open(path) as f, zipfile.ZipFile(f) as z:
            return z.infolist()


def _first(found: Iterator[Recording]) -> list[Recording]:
    """One recording of each id, the first, in order of their ids."""
    out: dict[str, Recording] = {}
    for r in found:
        out.setdefault(r.rec, r)
    return [out[k] for k in sorted(out)]


# ---------------------------------------------------------------- layouts: what lies below a path


def _everywhere(store: Store, pattern: re.Pattern) -> Iterator[tuple[re.Match, str, str | None, list[str]]]:
    """(match, file, member, names beside it), archives first."""
    files = store.files()
    for path in (f for f in files if f.endswith(".zip")):
        names = [m.filename for m in store.members(path)]
        yield from ((m, path, n, names) for n in names if (m := pattern.search(n)))
    yield from ((m, path, None, files) for path in files if not path.endswith(".zip") and (m := pattern.search(path)))


def contact_af(store: Store) -> list[Recording]:
    """mimic_perform_(non_af|af)_<n>_data.csv."""
    found = _everywhere(store, re.compile(r"mimic_perform_(non_af|af)_(\d+)_data\.csv$"))
    return _first(Recording(f"{m[1]}_{m[2]}", path, member, dataset="contact", subject=f"{m[1]}_{m[2]}", af=m[1] == "af") for m, path, member, _ in found)


def contact_testing(store: Store) -> list[Recording]:
    """mimic_perform_test_all_<n>_data.csv, with its group in ..._fix.txt beside it."""

    def described() -> Iterator[Recording]:
        for m, path, member, names in _everywhere(store, re.compile(r"mimic_perform_test_all_(\d+)_data\.csv$")):
            side = next((n for n in names if n.endswith(f"test_all_{m[1]}_fix.txt")), None)
            r = Recording(f"test_all_{m[1]}", path, member, side, "contact", f"test_all_{m[1]}", af=False)
            group = re.search(rb"Group: *(\w*)", store.bytes(r, side)) if side else None
            yield replace(r, grp=group[1].decode() if group else "")

    return _first(described())


def _folders(store: Store) -> dict[str, list[str]]:
    out: dict[str, list[str]] = {}
    for f in store.files():
        out.setdefault(f.rpartition("/")[0], []).append(f)
    return out


def _with_video(store: Store, truth: str, keep: re.Pattern):
    """(folder name, truth file) of folders that have a video and the truth; others are incomplete."""
    for folder, files in _folders(store).items():
        name = folder.rpartition("/")[2]
        if keep.search(name) and {f"{folder}/vid.avi", f"{folder}/{truth}"} <= set(files):
            yield name, f"{folder}/{truth}"


def face_lines(store: Store) -> list[Recording]:
    """subject<n>/vid.avi and ground_truth.txt: three lines of values, rates and times."""
    return _first(Recording(name, path, dataset="face-2", subject=re.search(r"\d+", name)[0]) for name, path in _with_video(store, TRUTHS[0], re.compile(r"^subject.*\d")))


def face_rows(store: Store) -> list[Recording]:
    """<n>-gt/vid.avi and gtdump.xmp: rows of time (ms), rate, saturation, value."""
    return _first(Recording(f"ubfc1_{name}", path, dataset="face-1", subject=f"ubfc1_{name}") for name, path in _with_video(store, TRUTHS[1], re.compile("")))


def face_json(store: Store) -> list[Recording]:
    """<subject>-<session>/<name>.json beside a folder of frames named by their time in nanoseconds."""

    def found() -> Iterator[Recording]:
        folders = _folders(store)
        for folder, files in folders.items():
            name = folder.rpartition("/")[2]
            frames = [f for f in folders.get(f"{folder}/{name}", []) if f.endswith(".png")]
            if "-" in name and f"{folder}/{name}.json" in files and frames:
                first = re.search(r"(\d+)", sorted(frames)[0].rpartition("/")[2])
                yield Recording(name, f"{folder}/{name}.json", side=f"{len(frames)} {first[1] if first else 0}", dataset="face-json", subject=name.split("-")[0], session=name.split("-")[1])

    return _first(found())


def annotations(store: Store) -> list[Recording]:
    """<nnn>annotations.txt."""
    return _first(Recording(m[1], path, member) for m, path, member, _ in _everywhere(store, re.compile(r"(\d{3})annotations\.txt$")))


def archives(store: Store) -> list[Recording]:
    """Zip archives, one partition each, for what they hold."""
    return [Recording(f, f) for f in store.files() if f.endswith(".zip")]


# ---------------------------------------------------------------- what is in one recording


def _waves(r: Recording, fs: float, t, ppg, ecg=None, resp=None) -> pa.RecordBatch:
    n = len(ppg)
    same = lambda v, kind: pa.array([v] * n, kind)
    real = lambda v: pa.nulls(n, pa.float64()) if v is None else pa.array(np.asarray(v, float), mask=np.isnan(np.asarray(v, float)))
    columns = [same(r.dataset, pa.string()), same(r.rec, pa.string()), same(r.subject, pa.string()), same(r.grp, pa.string()), same(r.af, pa.bool_()), same(r.session, pa.string()), same(fs, pa.float64()), pa.array(np.arange(n)), real(t), real(ppg), real(ecg), real(resp)]
    return pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in WAVES.split(", ")])


def read_table(store: Store, r: Recording) -> pa.RecordBatch:
    """A CSV with Time, PPG and perhaps ECG and resp; the sampling rate from the median step."""
    d = pd.read_csv(io.BytesIO(store.bytes(r)))
    t = d["Time"].to_numpy(float)
    step = float(np.median(np.diff(t))) if len(t) > 1 else 0.0
    column = lambda c: d[c].to_numpy(float) if c in d else None
    return _waves(r, float(round(1 / step)) if step > 0 else 125.0, t, d["PPG"].to_numpy(float), column("ECG"), column("resp"))


def read_lines(store: Store, r: Recording) -> pa.RecordBatch:
    lines = [x.split() for x in store.bytes(r).decode().strip().split("\n")]
    v = np.array(lines[0], float)
    t = np.array(lines[2], float) if len(lines) > 2 and len(lines[2]) == len(v) else None
    return _waves(r, 30.0, t, v)


def read_rows(store: Store, r: Recording) -> pa.RecordBatch:
    """Times are those of the sensor; the video has none, so the pulse is stretched over it later."""
    d = np.atleast_2d(np.loadtxt(io.BytesIO(store.bytes(r)), delimiter=","))
    t = (d[:, 0] - d[0, 0]) / 1000
    step = float(np.median(np.diff(t))) if len(t) > 1 else 0.0
    return _waves(r, float(round(1 / step)) if step > 0 else 60.0, t, d[:, 3])


def read_json(store: Store, r: Recording) -> pa.RecordBatch:
    """Times in seconds from the first frame, whose time is that of the list of frames if it is as long as their folder,
    else that of the first file's name."""
    d = json.loads(store.bytes(r))
    frames, first = (int(x) for x in r.side.split())
    listed = [p["Timestamp"] for p in d.get("/Image", [])]
    t0 = listed[0] if listed and len(listed) == frames else first
    package = d["/FullPackage"]
    t = np.array([(p["Timestamp"] - t0) / 1e9 for p in package], float)
    return _waves(r, 30.0, t, np.array([p["Value"]["waveform"] for p in package], float))


def read_beats(store: Store, r: Recording) -> pa.RecordBatch:
    """Beats with the rhythm that the last rhythm mark before them began: marks are `+` with an aux that starts with "("."""
    out: dict[str, list] = {"beat": [], "t": [], "symbol": [], "in_af": []}
    in_af = False
    for line in store.bytes(r).decode().splitlines()[1:]:
        parts = line.split()
        if len(parts) < 3:
            continue
        aux = line.split("\t")[-1].strip() if "\t" in line else ""
        if parts[2] == "+" and aux.startswith("("):
            in_af = aux.startswith(AF_RHYTHMS)
        elif parts[2] in BEAT_SYMBOLS:
            for k, v in (("beat", int(parts[1])), ("t", int(parts[1]) / ANNOTATION_FS), ("symbol", parts[2]), ("in_af", in_af)):
                out[k].append(v)
    return pa.RecordBatch.from_arrays([pa.array([r.rec] * len(out["t"]), pa.string()), pa.array(out["beat"], pa.int64()), pa.array(out["t"], pa.float64()), pa.array(out["symbol"], pa.string()), pa.array(out["in_af"], pa.bool_())], names=["rec", *out])


def read_archive(store: Store, r: Recording) -> pa.RecordBatch:
    """Members <dataset>/<subject>/<file> that are a truth or a video."""
    rows = []
    for m in store.members(r.path):
        parts = m.filename.split("/")
        kind = "truth" if parts[-1] in TRUTHS else "video" if parts[-1].endswith(".avi") else None
        if len(parts) == 3 and kind:
            rows.append((r.path, parts[0], parts[1], m.filename, kind, m.file_size))
    kinds = [pa.string()] * 5 + [pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array([x[k] for x in rows], kinds[k]) for k in range(6)], names=[c.split()[0] for c in PARTS.split(", ")])


#: form -> (schema, what lies below a path, what is in one recording)
LAYOUTS = {
    "contact_af": (WAVES, contact_af, read_table),
    "contact_testing": (WAVES, contact_testing, read_table),
    "face_lines": (WAVES, face_lines, read_lines),
    "face_rows": (WAVES, face_rows, read_rows),
    "face_json": (WAVES, face_json, read_json),
    "annotations": (BEATS, annotations, read_beats),
    "archives": (PARTS, archives, read_archive),
}


class RecordingsReader(DataSourceReader):
    def __init__(self, options: dict):
        self.form, self.path, self.paced = options["form"], options["path"], options.get("paced", "false") == "true"
        self.wanted: list[tuple[str, set]] = []

    def pushFilters(self, filters: list[Filter]):
        """Equality on what a recording's name says prunes recordings; everything else is left to Spark."""
        for f in filters:
            name = ".".join(f.attribute) if isinstance(f, (EqualTo, EqualNullSafe, In)) else ""
            if name in ("rec", "grp", "dataset") and self.form != "archives":
                self.wanted.append((name, set(f.value) if isinstance(f, In) else {f.value}))
            yield f  # Spark checks rows again

    def partitions(self) -> list[Recording]:
        found = LAYOUTS[self.form][1](Store(self.path))
        if self.form == "annotations" and not self.paced:
            found = [r for r in found if r.rec not in PACED]
        return [r for r in found if all(getattr(r, name) in values for name, values in self.wanted)]

    def read(self, partition: Recording | None):
        if partition is None:  # nothing was found
            return
        yield LAYOUTS[self.form][2](Store(self.path), partition)


class Recordings(DataSource):
    @classmethod
    def name(cls) -> str:
        return "recordings"

    def schema(self) -> str:
        if self.options.get("form") not in LAYOUTS:
            raise ValueError(f"form must be one of {', '.join(LAYOUTS)}")
        return LAYOUTS[self.options["form"]][0]

    def reader(self, schema) -> RecordingsReader:
        return RecordingsReader(dict(self.options))


def read(spark: SparkSession, form: str, path: str, **options: str) -> DataFrame:
    """Recordings of a form below a path, with filters pushed to their names."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Recordings)
    return spark.read.format("recordings").options(form=form, path=path, **options).load()


def matched_parts(parts: DataFrame) -> DataFrame:
    """(dataset, subject, zip, member, truth_zip, truth, folder) of `archives`: each subject's first video and its truth, if
    there is one, and the folder that its result belongs to."""
    first = lambda kind, *names: parts.where(F.col("kind") == kind).groupBy("dataset", "subject").agg(F.min(F.struct("zip", "member")).alias("m")).select("dataset", "subject", *[F.col(f"m.{a}").alias(b) for a, b in zip(("zip", "member"), names, strict=True)])
    pairs = first("video", "zip", "member").join(first("truth", "truth_zip", "truth"), ["dataset", "subject"], "left")
    return pairs.withColumn("folder", F.when(F.col("truth").isNull(), "noref").when(F.col("dataset") == "DATASET_2", "ubfc").otherwise("ubfc1"))


def write_new(rows: DataFrame, path: str, key: str = "rec", folder: str | None = None) -> None:
    """Appends the records that the Parquet table at path doesn't have yet, so that a repeated run adds nothing."""
    spark = rows.sparkSession
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        rows = rows.join(spark.read.parquet(path).select(key).distinct(), key, "left_anti")
    out = rows.write.mode("append")
    (out.partitionBy(folder) if folder else out).parquet(path)
