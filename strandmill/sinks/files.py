"""Files whose bytes depend on the rows only."""

from __future__ import annotations

import hashlib
import json
import os
import shutil
from collections.abc import Iterator, Sequence
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame

from strandmill.gates import GateError
from strandmill.sources.registry import sha256_of


def _cell(v: Any) -> str:
    if v is None:
        return ""
    if isinstance(v, float):
        return format(v, ".10g")
    if isinstance(v, bool):
        return "1" if v else "0"
    if isinstance(v, (list, tuple)):
        return ";".join(_cell(x) for x in v)
    return str(v).replace("\t", " ").replace("\r", " ").replace("\n", " ")


def _lines(df: DataFrame, columns: Sequence[str], order: Sequence[str]) -> Iterator[str]:
    yield "\t".join(columns) + "\n"
    for r in df.select(*columns).orderBy(*order).toLocalIterator():
        yield "\t".join(_cell(v) for v in r) + "\n"


def write_tsv(df: DataFrame, path: str | Path, columns: Sequence[str], order: Sequence[str]) -> str:
    """One tab-separated file with ``\\n`` line ends in a total order; other columns are left out. Gives its checksum.

    Rows come to the driver one partition at a time, so it is meant for results; large tables are written by Spark.
    """
    tmp = Path(f"{path}.part")
    tmp.parent.mkdir(parents=True, exist_ok=True)
    with open(tmp, "w", encoding="utf-8", newline="") as f:
        f.writelines(_lines(df, columns, order))
    os.replace(tmp, path)
    return sha256_of(path)


def append_only(df: DataFrame, path: str | Path, columns: Sequence[str], order: Sequence[str]) -> str:
    """Write where there is nothing; equal bytes are left alone; different ones are refused. Gives ``written`` or ``unchanged``."""
    new = Path(f"{path}.new")
    digest = write_tsv(df, new, columns, order)
    if not Path(path).exists():
        os.replace(new, path)
        return "written"
    same = sha256_of(path) == digest
    new.unlink()
    if not same:
        raise GateError(f"{path} holds different rows; it is append-only")
    return "unchanged"


def prefix_append(df: DataFrame, path: str | Path, columns: Sequence[str], order: Sequence[str]) -> int:
    """Keep the bytes of a file and append the sorted rows that it lacks; gives how many were added.

    The new file is written beside the old one and put in its place at the end, so that a failure leaves the old one.
    Lines are compared by their hashes; rows come to the driver one partition at a time.
    """
    p, tmp = Path(path), Path(f"{path}.part")
    tmp.parent.mkdir(parents=True, exist_ok=True)
    have: set[bytes] = set()
    head = ("\t".join(columns) + "\n").encode("utf-8")
    digest = lambda line: hashlib.blake2b(line, digest_size=16).digest()
    added = 0
    with open(tmp, "wb") as out:
        if p.exists():
            with open(p, "rb") as old:
                if old.readline() != head:
                    tmp.unlink()
                    raise GateError(f"{path}: its columns differ")
                for line in old:
                    have.add(digest(line))
            with open(p, "rb") as old:
                shutil.copyfileobj(old, out)
        else:
            out.write(head)
        for line in _lines(df, columns, order):
            data = line.encode("utf-8")
            if data != head and digest(data) not in have:
                out.write(data)
                added += 1
    os.replace(tmp, p)
    return added


def manifest(path: str | Path, **content: Any) -> None:
    """A JSON file with sorted keys."""
    Path(path).write_text(json.dumps(content, ensure_ascii=False, sort_keys=True, indent=2, default=str) + "\n", encoding="utf-8")


def checksums(folder: str | Path, name: str = "SHA256SUMS") -> dict[str, str]:
    """Write the checksums of all files of a folder but the list itself."""
    d = Path(folder)
    sums = {str(p.relative_to(d)): sha256_of(p) for p in sorted(d.rglob("*")) if p.is_file() and p.name != name}
    (d / name).write_text("".join(f"{v}  {k}\n" for k, v in sums.items()), encoding="utf-8")
    return sums


def empty_dir(path: str | Path) -> Path:
    """The folder, made if it isn't there; refused if it holds something."""
    p = Path(path)
    if p.exists() and any(p.iterdir()):
        raise GateError(f"{p} is not empty")
    p.mkdir(parents=True, exist_ok=True)
    return p


def copy_verified(source: str | Path, target: str | Path) -> str:
    """Copy a file and compare both checksums."""
    Path(target).parent.mkdir(parents=True, exist_ok=True)
    shutil.copyfile(source, target)
    if (digest := sha256_of(source)) != sha256_of(target):
        raise GateError(f"{target} differs from {source} after the copy")
    return digest


