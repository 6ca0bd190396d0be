"""File readers as data sources: array archives (``array_archive``) and coordinate files (``atom_file``).

Both plan partitions of whole files by bytes on the driver, prune files or rows by pushed filters, and read only what the schema
asks for; tasks open files by their URI, in any store that pyarrow.fs knows, and give Arrow batches.
"""

from __future__ import annotations

import gzip
import io
import json
import re
import zipfile
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, Not
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, StructType

#: Bytes of files that one task reads, unless the option ``bytes`` says otherwise; one larger file is read alone.
TASK_BYTES = 64 << 20


def register(spark: SparkSession) -> None:
    """Makes the formats known to a session, and lets their readers see filters."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for source in (ArrayArchives, AtomFiles):
        spark.dataSource.register(source)


@dataclass
class Files(InputPartition):
    """The files of one task."""

    paths: tuple[str, ...]


def stem(path: str) -> str:
    return re.sub(r"\.[A-Za-z0-9]+(\.gz)?$", "", path.rsplit("/", 1)[-1])


def planned(path: str, endings: Sequence[str], most: int, takes) -> list[Files]:
    """Files with one of the endings below the path, in order of their names, in groups of some ``most`` bytes; ``takes`` judges a name."""
    store, folder = pafs.FileSystem.from_uri(path)
    info = store.get_file_info(folder)
    if info.type == pafs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = [info] if info.type == pafs.FileType.File else store.get_file_info(pafs.FileSelector(folder, recursive=True))
    scheme = path.split("://", 1)[0] + "://" if "://" in path else ""
    host = path.split("://", 1)[1].split("/", 1)[0] if scheme not in ("", "file://") else ""
    groups: list[list[str]] = []
    room = 0
    for f in sorted(found, key=lambda f: f.path):
        if f.type != pafs.FileType.File or not f.path.endswith(tuple(endings)) or not takes(stem(f.path)):
            continue
        if room < f.size or not groups:
            groups.append([])
            room = most
        groups[-1].append(scheme + host + f.path if not host or not f.path.startswith(host) else scheme + f.path)
        room -= f.size
    return [Files(tuple(g)) for g in groups]


def content(path: str) -> bytes:
    store, file = pafs.FileSystem.from_uri(path)
    with store.open_input_file(file) as source:
        data = source.read()
    return gzip.decompress(data) if path.endswith(".gz") else data


def allowed(f: Filter, column: str) -> set | None:
    """The values that an equality or membership filter on a column allows."""
    if isinstance(f, EqualTo) and f.attribute == (column,):
        return {f.value}
    if isinstance(f, In) and f.attribute == (column,):
        return set(f.value)
    return None


class PrunedReader(DataSourceReader):
    """Takes filters of equality and membership on some columns, and their opposites: the values that are wanted and unwanted."""

    prunes: tuple[str, ...] = ()

    def __init__(self, schema: StructType, options) -> None:
        self.schema, self.options = schema, dict(options)
        self.wanted: dict[str, set] = {}
        self.unwanted: dict[str, set] = {}
        if "path" not in self.options:
            raise ValueError("load() needs a path")

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            for column in self.prunes:
                if (values := allowed(f, column)) is not None:
                    self.wanted[column] = self.wanted.get(column, values) & values
                    break
                if isinstance(f, Not) and (values := allowed(f.child, column)) is not None:
                    self.unwanted[column] = self.unwanted.get(column, set()) | values
                    break
            else:
                yield f

    def takes(self, column: str, value) -> bool:
        return (column not in self.wanted or value in self.wanted[column]) and value not in self.unwanted.get(column, ())

    def option(self, name: str, default: str = "") -> str:
        return self.options.get(name, self.options.get(name.lower(), default))


# --- array archives ---------------------------------------------------------------------------


class ArrayArchives(DataSource):
    """One row for each ``.npz`` archive: ``name`` (the file's, without ending) and the arrays that the read's schema names; others aren't decompressed.

    Options: version (the value that each archive's ``schema_version`` must have), required (arrays that each archive must
    have, read or not, comma-joined), defaults (JSON: values of arrays that an archive may lack), bytes (of files for a task).
    A wrong or missing version, a missing required array, a missing array without default and an array of another
    rank or kind than the schema says are errors that name the file. A filter on ``name`` prunes files.
    """

    @classmethod
    def name(cls) -> str:
        return "array_archive"

    def schema(self):
        raise ValueError("array_archive: give a schema; its columns are the arrays to read")

    def reader(self, schema: StructType) -> ArrayReader:
        return ArrayReader(schema, self.options)


class ArrayReader(PrunedReader):
    prunes = ("name",)

    def partitions(self) -> list[Files]:
        return planned(self.options["path"], [".npz"], int(self.option("bytes", str(TASK_BYTES))), lambda name: self.takes("name", name)) or [Files(())]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        kinds = to_arrow_schema(self.schema)
        required = [x for x in self.option("required").split(",") if x]
        defaults = json.loads(self.option("defaults", "{}"))
        for path in partition.paths:
            row = archive_row(path, self.schema, self.option("version"), required, defaults)
            yield pa.RecordBatch.from_arrays([pa.array([row[f.name]], f.type) for f in kinds], schema=kinds)


def rank(kind) -> int:
    return 1 + rank(kind.elementType) if isinstance(kind, ArrayType) else 0


def archive_row(path: str, schema: StructType, version: str, required: Sequence[str], defaults: dict) -> dict:
    """The wanted arrays of one archive, after its gates."""
    try:
        archive = np.load(io.BytesIO(content(path)), allow_pickle=False)
    except (ValueError, OSError, EOFError, zipfile.BadZipFile) as error:
        raise ValueError(f"{path}: not an array archive ({error})") from error
    with archive:
        have = set(archive.files)
        told = str(archive["schema_version"]) if "schema_version" in have else None
        if version and told != version:
            raise ValueError(f"{path}: schema version {told}, not {version}")
        if missing := [x for x in required if x not in have]:
            raise ValueError(f"{path}: required arrays are missing: {missing}")
        row = {}
        for f in schema:
            if f.name == "name":
                row["name"] = stem(path)
            elif f.name in have:
                value = archive[f.name]
                if value.ndim != rank(f.dataType):
                    raise ValueError(f"{path}: array {f.name} has {value.ndim} dimensions, not {rank(f.dataType)}")
                row[f.name] = value.tolist()
            elif f.name in defaults:
                row[f.name] = defaults[f.name]
            else:
                raise ValueError(f"{path}: no array {f.name}, and no default")
        return row


def write_archives(rows: DataFrame, by: str, arrays: Sequence[str], version: str, path: str) -> DataFrame:
    """Writes an archive ``BY.npz`` for each value of ``by`` with the columns as arrays in the order of the first of them: by, bytes.

    A value's rows are one archive, so they meet in one task. A file is put in place by a rename; a task that runs again writes the same bytes.
    """
    kind = rows.schema[by].dataType.simpleString()

    def write(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(arrays[0], kind="stable")
        out = io.BytesIO()
        np.savez_compressed(out, schema_version=np.array(version), **{a: np.array(pdf[a].tolist()) for a in arrays})
        put(path, f"{pdf[by].iloc[0]}.npz", out.getvalue())
        return pd.DataFrame({by: [pdf[by].iloc[0]], "bytes": [out.tell()]})

    return rows.select(by, *arrays).groupBy(by).applyInPandas(write, f"{by} {kind}, bytes long")


def put(path: str, name: str, data: bytes) -> None:
    """A file in a folder, whole or not at all."""
    store, folder = pafs.FileSystem.from_uri(path)
    store.create_dir(folder, recursive=True)
    temporary = f"{folder}/_{name}.{np.random.default_rng().integers(1 << 62):x}"
    with store.open_output_stream(temporary) as out:
        out.write(data)
    if store.get_file_info(f"{folder}/{name}").type != pafs.FileType.NotFound:
        store.delete_file(f"{folder}/{name}")
    store.move(temporary, f"{folder}/{name}")


# --- coordinate files -------------------------------------------------------------------------

ATOM_COLUMNS = "file string, model int, chain string, residue_name string, residue_number int, insertion string, altloc string, atom_name string, element string, x double, y double, z double, occupancy double, b_iso double, hetero boolean"
LINK_COLUMNS = "file string, kind string, a_chain string, a_residue_number int, a_atom string, b_chain string, b_residue_number int, b_atom string"


class AtomFiles(DataSource):
    """Atoms of mmCIF (``.cif``, ``.mmcif``) and PDB (``.pdb``, ``.ent``) files, gzipped or not; with option content=links their explicit connections.

    Columns: ATOM_COLUMNS or LINK_COLUMNS; a schema may name fewer. Option bytes: of files for a task. Filters on file prune files,
    those on model and chain prune lines before they are parsed further. A file without atoms, a residue without a number and
    a coordinate that is not finite are errors that name the file; a missing occupancy is 1, a missing temperature factor null.
    """

    @classmethod
    def name(cls) -> str:
        return "atom_file"

    def schema(self) -> str:
        return LINK_COLUMNS if self.options.get("content") == "links" else ATOM_COLUMNS

    def reader(self, schema: StructType) -> AtomReader:
        return AtomReader(schema, self.options)


class AtomReader(PrunedReader):
    prunes = ("file", "model", "chain")

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        if self.option("content") == "links":
            self.prunes = ("file",)
        return super().pushFilters(filters)

    def partitions(self) -> list[Files]:
        ends = [e + z for e in (".cif", ".mmcif", ".pdb", ".ent") for z in ("", ".gz")]
        return planned(self.options["path"], ends, int(self.option("bytes", str(TASK_BYTES))), lambda name: self.takes("file", name)) or [Files(())]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        kinds = to_arrow_schema(self.schema)
        links = self.option("content") == "links"
        for path in partition.paths:
            text = content(path).decode()
            cif = re.search(r"\.(cif|mmcif)(\.gz)?$", path)
            if links:
                rows = list(cif_links(text) if cif else pdb_links(text))
            else:
                rows = list(atoms_of(path, cif_atoms(text) if cif else pdb_atoms(text), self.takes))
            columns = {f.name: [r.get(f.name) if f.name != "file" else stem(path) for r in rows] for f in kinds}
            yield pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in kinds], schema=kinds)


def atoms_of(path: str, rows: Iterator[dict], takes) -> Iterator[dict]:
    """Atoms with numbers, of the wanted models and chains."""
    n = 0
    for r in rows:
        n += 1
        if not all(takes(c, r[c]) for c in ("model", "chain")):
            continue
        if r["residue_number"] is None:
            raise ValueError(f"{path}: atom {n} has no residue number")
        if not all(np.isfinite(r[c]) for c in "xyz"):
            raise ValueError(f"{path}: atom {n} has coordinates that are not finite")
        yield r
    if not n:
        raise ValueError(f"{path}: no atoms")


def number(text: str | None, kind=float):
    return None if text is None or not text.strip() else kind(text)


def pdb_atoms(text: str) -> Iterator[dict]:
    """ATOM and HETATM lines by their fixed columns; MODEL lines count models from 1."""
    model = 1
    for line in text.splitlines():
        if line.startswith("MODEL "):
            model = int(line[10:14])
        elif line.startswith(("ATOM  ", "HETATM")):
            line = line.ljust(80)
            name = line[12:16].strip()
            yield {
                "model": model, "chain": line[21].strip(), "residue_name": line[17:20].strip(), "residue_number": number(line[22:26], int), "insertion": line[26].strip() or None, "altloc": line[16].strip() or None,
                "atom_name": name, "element": line[76:78].strip().upper() or name.lstrip("0123456789")[:1].upper(), "x": float(line[30:38]), "y": float(line[38:46]), "z": float(line[46:54]),
                "occupancy": 1.0 if number(line[54:60]) is None else float(line[54:60]), "b_iso": number(line[60:66]), "hetero": line.startswith("HETATM"),
            }


def pdb_links(text: str) -> Iterator[dict]:
    """SSBOND and LINK lines; a disulfide joins the SG atoms."""
    for line in text.splitlines():
        line = line.ljust(80)
        if line.startswith("SSBOND"):
            yield {"kind": "disulf", "a_chain": line[15].strip(), "a_residue_number": int(line[17:21]), "a_atom": "SG", "b_chain": line[29].strip(), "b_residue_number": int(line[31:35]), "b_atom": "SG"}
        elif line.startswith("LINK  "):
            yield {"kind": "link", "a_chain": line[21].strip(), "a_residue_number": int(line[22:26]), "a_atom": line[12:16].strip(), "b_chain": line[51].strip(), "b_residue_number": int(line[52:56]), "b_atom": line[42:46].strip()}


#: A token of a CIF file at a place: a quoted text (its closing quote has white space behind it), or a run without white space.
_CIF = re.compile(r"'((?:[^'\n]|'(?=\S))*)'(?=\s|$)|\"((?:[^\"\n]|\"(?=\S))*)\"(?=\s|$)|(\S+)")


def cif_tokens(text: str) -> Iterator[tuple[bool, str]]:
    """(quoted, token) in order; comments are left out, a text field between lines that begin with a semicolon is one quoted token."""
    field: list[str] | None = None
    for line in text.splitlines():
        if field is not None:
            if line.startswith(";"):
                yield True, "\n".join(field)
                field, line = None, line[1:]
            else:
                field.append(line)
                continue
        elif line.startswith(";"):
            field = [line[1:]]
            continue
        at = 0
        while m := _CIF.search(line, at):
            if m[3] is not None and m[3].startswith("#"):
                break
            yield m[3] is None, m[3] if m[3] is not None else m[1] if m[1] is not None else m[2]
            at = m.end()


def cif_category(text: str, category: str) -> Iterator[dict[str, str | None]]:
    """The rows of a category, from its loop or its single items; ``.`` and ``?`` are null."""
    prefix = category.lower() + "."
    names: list[str] | None = None
    single: dict[str, str | None] = {}
    row: list[str | None] = []
    key = None
    heading = False
    for quoted, token in cif_tokens(text):
        low = token.lower()
        if not quoted and low.startswith("_"):
            if heading:
                names.append(low)
            else:
                names, key = None, low
            continue
        if not quoted and (low == "loop_" or low.startswith("data_")):
            names, heading, key, row = [] if low == "loop_" else None, low == "loop_", None, []
            continue
        heading = False
        value = None if not quoted and token in (".", "?") else token
        if names:
            if names[0].startswith(prefix):
                row.append(value)
                if len(row) == len(names):
                    yield {n.removeprefix(prefix): v for n, v in zip(names, row, strict=True)}
                    row = []
        elif key:
            if key.startswith(prefix):
                single[key.removeprefix(prefix)] = value
            key = None
    if single:
        yield single


def cif_atoms(text: str) -> Iterator[dict]:
    """The atom_site rows, by author names where there are any."""
    for r in cif_category(text, "_atom_site"):
        name = r.get("auth_atom_id") or r.get("label_atom_id") or ""
        occupancy = number(r.get("occupancy"))
        yield {
            "model": number(r.get("pdbx_pdb_model_num"), int) or 1, "chain": r.get("auth_asym_id") or r.get("label_asym_id"), "residue_name": r.get("auth_comp_id") or r.get("label_comp_id"), "residue_number": number(r.get("auth_seq_id") or r.get("label_seq_id"), int),
            "insertion": r.get("pdbx_pdb_ins_code"), "altloc": r.get("label_alt_id"), "atom_name": name, "element": (r.get("type_symbol") or name[:1]).upper(), **{c: float(r.get(f"cartn_{c}") or "nan") for c in "xyz"},
            "occupancy": 1.0 if occupancy is None else occupancy, "b_iso": number(r.get("b_iso_or_equiv")), "hetero": r.get("group_pdb") == "HETATM",
        }


def cif_links(text: str) -> Iterator[dict]:
    """The struct_conn rows."""
    for r in cif_category(text, "_struct_conn"):
        end = lambda k: {"chain": r.get(f"ptnr{k}_auth_asym_id") or r.get(f"ptnr{k}_label_asym_id"), "residue_number": number(r.get(f"ptnr{k}_auth_seq_id") or r.get(f"ptnr{k}_label_seq_id"), int), "atom": r.get(f"ptnr{k}_label_atom_id")}
        yield {"kind": r.get("conn_type_id"), **{f"a_{c}": v for c, v in end(1).items()}, **{f"b_{c}": v for c, v in end(2).items()}}


def pdb_text(rows: pd.DataFrame) -> str:
    """Atoms as fixed columns, by model, in the order given."""
    lines = []
    for model, own in rows.groupby("model", sort=True):
        lines.append(f"MODEL     {model:4d}")
        for i, r in enumerate(own.itertuples(), 1):
            lines.append(f"{'HETATM' if r.hetero else 'ATOM  '}{i % 100000:5d} {r.atom_name:<4.4s}{r.altloc or '':1.1s}{r.residue_name:>3.3s} {r.chain:1.1s}{r.residue_number:4d}    {r.x:8.3f}{r.y:8.3f}{r.z:8.3f}{r.occupancy:6.2f}{r.b_iso:6.2f}          {r.element:>2.2s}")
        lines.append("ENDMDL")
    return "\n".join([*lines, "END", ""])


#: The items of a written atom_site loop.
_SITE = "group_PDB id type_symbol label_atom_id label_alt_id label_comp_id auth_asym_id auth_seq_id Cartn_x Cartn_y Cartn_z occupancy B_iso_or_equiv pdbx_PDB_model_num".split()


def cif_text(name: str, rows: pd.DataFrame) -> str:
    """Atoms as an atom_site loop."""
    quoted = lambda v: "." if v is None else f'"{v}"' if re.search(r"['\s#_]", str(v)) or not str(v) else str(v)
    lines = [f"data_{name}", "loop_", *(f"_atom_site.{c}" for c in _SITE)]
    for i, r in enumerate(rows.itertuples(), 1):
        values = ("HETATM" if r.hetero else "ATOM", i, r.element, r.atom_name, r.altloc, r.residue_name, r.chain, r.residue_number, f"{r.x:.3f}", f"{r.y:.3f}", f"{r.z:.3f}", f"{r.occupancy:.2f}", f"{r.b_iso:.2f}", r.model)
        lines.append(" ".join(quoted(v) for v in values))
    return "\n".join([*lines, "#", ""])


def write_atoms(atoms: DataFrame, path: str, order: str) -> DataFrame:
    """Writes the atoms (ATOM_COLUMNS and an order) as one file each: files whose ``format`` is cif as mmCIF, others as PDB: file, bytes. A file's atoms meet in one task."""

    def write(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable")
        pdf["altloc"] = pdf["altloc"].where(pdf["altloc"].notna(), None)
        name, cif = pdf["file"].iloc[0], pdf["format"].iloc[0] == "cif"
        data = (cif_text(name, pdf) if cif else pdb_text(pdf)).encode()
        put(path, f"{name}.{'cif' if cif else 'pdb'}", data)
        return pd.DataFrame({"file": [name], "bytes": [len(data)]})

    return atoms.groupBy("file").applyInPandas(write, "file string, bytes long")
