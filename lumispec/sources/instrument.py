"""Readers of instrument data: Bruker directories and zips of them, and JCAMP-DX files.

Samples are listed on the driver; their files are parsed in tasks, one row a sample. Where a sample fails, its row
has the error and no data, so one bad sample never loses the others.
"""

from __future__ import annotations

import glob
import io
import os
import re
import zipfile
from datetime import datetime, timezone

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The folder of adjustment data inside archives; never a sample.
SKIPPED = "98888"
SCHEMA = "sample_id string, path string, status string, error string, dimension int, pulse_sequence string, acquired timestamp, parameters map<string,string>, axis array<double>, data_1r array<double>, data_1i array<double>"


def natural(name: str) -> list:
    return [(0, int(x), "") if x.isdigit() else (1, 0, x) for x in re.findall(r"\d+|\D+", name)]


def file_lister(path: str, pattern: str) -> list[str]:
    return sorted(glob.glob(os.path.join(path, pattern)), key=natural)


def sample_names(paths: list[str]) -> list[str]:
    """Base names without endings; with the folder before them where two are equal, and numbered where they still are."""
    plain = [re.sub(r"\.zip!.*$", ".zip", p).rstrip("/") for p in paths]
    stem = lambda p: re.sub(r"\.[A-Za-z][^./]*$", "", os.path.basename(p))
    names = [stem(p) for p in plain]
    if len(set(names)) < len(names):
        names = [os.path.join(os.path.basename(os.path.dirname(p)), n) if os.path.dirname(p) else n for p, n in zip(plain, names)]
    if len(set(names)) < len(names):
        names = [f"{n}...{k + 1}" if names.count(n) > 1 else n for k, n in enumerate(names)]
    return names


def value_of(raw: str):
    """A number, a list of numbers, or a string without its angle brackets."""
    raw = raw.strip()
    if raw.startswith("<") and raw.endswith(">"):
        return raw[1:-1]
    parts = raw.split()
    try:
        numbers = [float(p) for p in parts]
    except ValueError:
        return raw
    return raw if not numbers else numbers[0] if len(numbers) == 1 else numbers


def read_parameters(text: str) -> dict:
    """Parameters of the ##$NAME= form; (0..n) vectors go on over lines; $$ lines are comments, the first with a time stamp kept as _stamp."""
    out, name, more = {}, None, []

    def close():
        if name is not None:
            out[name] = value_of(" ".join(more))

    for line in text.splitlines():
        if line.startswith("$$"):
            if "_stamp" not in out and re.search(r"\d{4}-\d\d-\d\d", line):
                out["_stamp"] = line[2:].strip()
            continue
        found = re.match(r"##\$?([^=]+)=\s*(.*)$", line)
        if found:
            close()
            name, rest = found[1].strip(), found[2].strip()
            more = [re.sub(r"^\(\d+\.\.\d+\)\s*", "", rest)]
            if name == "END":
                name = None
        elif name is not None:
            more.append(line.strip())
    close()
    return out


def read_title(text: str) -> dict:
    """Names and values if every line has two words or more, else V1, V2 and on."""
    lines = [x for x in text.splitlines() if x.strip()]
    if lines and all(len(x.split()) >= 2 for x in lines):
        return {x.split(None, 1)[0]: x.split(None, 1)[1].strip() for x in lines}
    return {f"V{k + 1}": x for k, x in enumerate(lines)}


def read_orig(text: str) -> dict:
    return {k: v.strip() for k, _, v in (x.partition(" ") for x in text.splitlines() if x.strip())}


def pulse_sequence(experiment: str) -> str | None:
    # Parts of experiment names, in the order they are tried.
    for name, parts in (("NOESY", ("NOESY", "NOEZY")), ("CPMG", ("CPMG",)), ("DIFF", ("DIFF",)), ("JRES", ("JRES",)), ("PROTON", ("PROTON",)), ("COSY", ("COSY",)), ("TOCSY", ("TOCSY", "MLEV", "DIPSI")), ("HSQC", ("HSQC",)), ("HMBC", ("HMBC",))):
        if any(p in experiment.upper() for p in parts):
            return name
    return None


def binary(raw: bytes, big: bool, power: float) -> list[float]:
    return (np.frombuffer(raw, ">i4" if big else "<i4") * 2.0**power).tolist()


class Folder:
    """Files of a directory, or of a folder inside a zip (archive.zip or archive.zip!/folder)."""

    def __init__(self, path: str):
        base, _, inside = path.partition("!")
        self.zip = zipfile.ZipFile(base) if base.endswith(".zip") else None
        self.base, self.inside = base, inside.strip("/")
        if self.zip is not None and not self.inside:
            tops = [os.path.dirname(n) for n in self.zip.namelist() if os.path.basename(n) == "acqus" and SKIPPED not in n.split("/")]
            if not tops:
                raise FileNotFoundError("no acquisition parameters in the archive")
            self.inside = min(tops, key=natural)

    def get(self, name: str) -> bytes | None:
        if self.zip is not None:
            full = f"{self.inside}/{name}".lstrip("/")
            return self.zip.read(full) if full in self.zip.namelist() else None
        full = os.path.join(self.base, name)
        if not os.path.isfile(full):
            return None
        with open(full, "rb") as f:
            return f.read()

    def text(self, name: str) -> str | None:
        raw = self.get(name)
        return None if raw is None else raw.decode("latin-1")


def reorder(data: np.ndarray, size: tuple[int, int], block: tuple[int, int]) -> np.ndarray:
    """A two-dimensional spectrum from its submatrices."""
    rows, cols = size[0] // block[0], size[1] // block[1]
    return data.reshape(rows, cols, *block).swapaxes(1, 2).reshape(size)


def axis_of(p: dict) -> list[float]:
    n = int(p["SI"])
    return np.linspace(p["OFFSET"], p["OFFSET"] - p["SW_p"] / p["SF"], n).tolist()


def read_bruker(path: str, wanted: str | None = None, metadata_only: bool = False, all_components: bool = False, pdata: str = "pdata/1") -> dict | None:
    """One sample; None if it is of another pulse sequence, which is known before any data are read."""
    folder = Folder(path)
    acq = [(n, folder.text(n)) for n in ("acqus", "acqu2s", "acqu3s", "acqu4s")]
    if acq[0][1] is None:
        raise FileNotFoundError("no acqus file")
    groups = {n: read_parameters(t) for n, t in acq if t is not None}
    pulse = pulse_sequence(str(groups["acqus"].get("EXP", "")))
    if wanted is not None and (pulse or "").upper() != wanted.upper():
        return None
    for k in ("", "2", "3", "4"):
        t = folder.text(f"{pdata}/proc{k}s")
        if t is not None:
            groups[f"proc{k}s"] = read_parameters(t)
    for name, parse in (("title", read_title), ("orig", read_orig)):
        t = folder.text(f"{pdata}/{name}") or (folder.text(name) if name == "orig" else None)
        if t is not None:
            groups[name] = parse(t)
    stamp = re.search(r"(\d{4}-\d\d-\d\d)[T ](\d\d:\d\d:\d\d)", str(groups["acqus"].get("_stamp", "")))
    out = {"dimension": sum(t is not None for _, t in acq), "pulse_sequence": pulse, "acquired": datetime.strptime(" ".join(stamp.groups()), "%Y-%m-%d %H:%M:%S").replace(tzinfo=timezone.utc) if stamp else None, "parameters": {f"{g}_{k}": " ".join(map(str, v)) if isinstance(v, list) else str(v) for g, p in groups.items() for k, v in p.items()}}
    if not metadata_only:
        p = groups.get("procs")
        if p is None:
            raise FileNotFoundError("no processing parameters")
        big, power = int(p.get("BYTORDP", 0)) == 1, float(p.get("NC_proc", 0))
        real = folder.get(f"{pdata}/1r")
        if real is not None:
            out |= {"axis": axis_of(p), "data_1r": binary(real, big, power)}
            other = folder.get(f"{pdata}/1i") if all_components else None
            if other is not None:
                out["data_1i"] = binary(other, big, power)
        else:
            real = folder.get(f"{pdata}/2rr")
            if real is None:
                raise FileNotFoundError("no processed data that are read: 1r or 2rr")
            q = groups["proc2s"]
            size = int(q["SI"]), int(p["SI"])
            block = int(q.get("XDIM") or size[0]), int(p.get("XDIM") or size[1])
            out |= {"axis": axis_of(p), "data_1r": reorder(np.array(binary(real, big, power)), size, block).ravel().tolist()}
    return out


def read_fid(path: str, big: bool = False, half: bool = False) -> list[float] | None:
    """Time-domain integers; None if there are none. half: only the first half of them, as some readers do."""
    raw = Folder(path).get("fid")
    if raw is None:
        return None
    all_ = np.frombuffer(raw, ">i4" if big else "<i4").astype(float).tolist()
    return all_[: len(raw) // 8] if half else all_


def strip_comments(lines: list[str]) -> list[str]:
    return [x.split("$$", 1)[0] for x in lines]


def read_jdx_blocks(text: str) -> list[dict]:
    """The blocks of a JCAMP-DX text, outer first: labels, and x and y where a block has data of the forms (XY..XY) or (X++(Y..Y))."""
    blocks, stack, name = [], [], None
    for line in strip_comments(text.splitlines()):
        found = re.match(r"##([^=]*)=(.*)$", line)
        if found:
            name = found[1].strip().upper()
            if name == "TITLE":
                stack.append({"labels": {}, "data": {}})
                blocks.append(stack[-1])
            if name == "END":
                if stack:
                    stack.pop()
                name = None
            elif stack:
                stack[-1]["labels"][name] = found[2].strip()
        elif name is not None and stack and line.strip():
            stack[-1]["data"].setdefault(name, []).append(line)
    for b in blocks:
        labels = b["labels"]
        key = next((k for k in ("XYDATA", "XYPOINTS", "PEAK TABLE") if k in labels and b["data"].get(k)), None)
        if key is None:
            continue
        fx, fy = float(labels.get("XFACTOR", 1) or 1), float(labels.get("YFACTOR", 1) or 1)
        form, lines = re.sub(r"\s", "", labels[key].upper()), b["data"][key]
        if form.startswith("(XY..XY)"):
            v = np.array([float(t) for t in re.split(r"[\s,;]+", " ".join(lines).strip())]).reshape(-1, 2)
            x, y = v[:, 0] * fx, v[:, 1] * fy
        elif form.startswith("(X++(Y..Y))"):
            y = np.array([float(t) for line in lines for t in re.findall(r"[+-]?[\d.]+(?:[eE][+-]?\d+)?", line)[1:]]) * fy
            first, last = (float(labels[k]) if k in labels else None for k in ("FIRSTX", "LASTX"))
            if first is None:
                first = float(re.findall(r"[+-]?[\d.]+", lines[0])[0]) * fx
            x = np.linspace(first, last, len(y)) if last is not None else first + float(labels["DELTAX"]) * np.arange(len(y))
        else:
            raise ValueError(f"data of the form {labels[key]} are not read")
        if labels.get("XUNITS", "").upper() == "HZ" and ".OBSERVE FREQUENCY" in labels:
            x = x / float(labels[".OBSERVE FREQUENCY"])
        b["x"], b["y"] = x.tolist(), y.tolist()
    return blocks


def read_jdx(path: str, wanted: str | None = None, metadata_only: bool = False) -> dict | None:
    with open(path, encoding="latin-1") as f:
        blocks = read_jdx_blocks(f.read())
    data = [b for b in blocks if "x" in b]
    if len(data) != 1:
        raise ValueError(f"{len(data)} blocks with data; there must be one")
    labels = {(f"b{k}_{n}" if k else n): v for k, b in enumerate(blocks) for n, v in b["labels"].items()}
    pulse = pulse_sequence(" ".join(v for n, v in labels.items() if n.endswith(".PULSE SEQUENCE")))
    if wanted is not None and (pulse or "").upper() != wanted.upper():
        return None
    out = {"dimension": 1, "pulse_sequence": pulse, "parameters": labels}
    return out if metadata_only else out | {"axis": data[0]["x"], "data_1r": data[0]["y"]}


def read_samples(spark: SparkSession, paths: dict[str, str] | list[str], format: str = "bruker", pulse_sequence: str | None = None, metadata_only: bool = False, keep_skipped: bool = False, all_components: bool = False) -> DataFrame:
    """A row a sample (SCHEMA); names of a dict are the samples' ids. status: ok, failed, or skipped (only with keep_skipped)."""
    if format not in ("bruker", "jdx"):
        raise ValueError(f"no such format: {format}")
    if not isinstance(paths, dict):
        paths = dict(zip(sample_names(list(paths)), paths))
    types = pa.schema([("sample_id", pa.string()), ("path", pa.string()), ("status", pa.string()), ("error", pa.string()), ("dimension", pa.int32()), ("pulse_sequence", pa.string()), ("acquired", pa.timestamp("us", "UTC")), ("parameters", pa.map_(pa.string(), pa.string())), *((n, pa.list_(pa.float64())) for n in ("axis", "data_1r", "data_1i"))])

    def run(batches):
        for batch in batches:
            for name, path in zip(batch.column("sample_id").to_pylist(), batch.column("path").to_pylist()):
                row = dict.fromkeys(types.names) | {"sample_id": name, "path": path, "status": "ok"}
                try:
                    got = read_bruker(path, pulse_sequence, metadata_only, all_components) if format == "bruker" else read_jdx(path, pulse_sequence, metadata_only)
                    row |= {"status": "skipped"} if got is None else got | {"parameters": list(got["parameters"].items())}
                except Exception as e:
                    row |= {"status": "failed", "error": f"{type(e).__name__}: {e}"}
                yield pa.RecordBatch.from_pylist([row], schema=types)

    listed = spark.createDataFrame(list(paths.items()), "sample_id string, path string").repartition(max(1, min(len(paths), 512)))
    out = listed.mapInArrow(run, SCHEMA)
    return out if keep_skipped else out.where("status <> 'skipped'")


def read_samples_dir(spark: SparkSession, directory: str | list[str], format: str = "bruker", **how) -> DataFrame:
    """The sub-folders and zips (bruker) or jdx files of directories, in natural order."""
    found = []
    for d in [directory] if isinstance(directory, str) else directory:
        if not os.path.isdir(d):
            raise FileNotFoundError(d)
        names = [os.path.join(d, n) for n in os.listdir(d)]
        found += [n for n in names if (os.path.isdir(n) or n.endswith("zip")) and os.path.basename(n) != SKIPPED] if format == "bruker" else [n for n in names if n.endswith("jdx")]
    return read_samples(spark, sorted(found, key=natural), format, **how)


def metadata(samples: DataFrame) -> DataFrame:
    """The samples' parameters as columns, the union of all names; null where a sample lacks one."""
    names = sorted(r[0] for r in samples.select(F.explode(F.map_keys("parameters"))).distinct().collect())  # parameter names of the instruments
    return samples.select("sample_id", *[F.try_element_at("parameters", F.lit(n)).alias(n.replace(".", "_")) for n in names])


def zip_samples(path: str, target: str, overwrite: bool = False) -> list[str]:
    """A zip for each sample folder; those that exist stay unless overwrite."""
    out = []
    for name in sorted(os.listdir(path), key=natural):
        folder, to = os.path.join(path, name), os.path.join(target, f"{name}.zip")
        if not os.path.isdir(folder):
            continue
        if overwrite or not os.path.exists(to):
            buffer = io.BytesIO()
            with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as z:
                for d, _, files in os.walk(folder):
                    for f in files:
                        z.write(os.path.join(d, f), os.path.relpath(os.path.join(d, f), path))
            with open(to, "wb") as f:
                f.write(buffer.getvalue())
        out.append(to)
    return out
