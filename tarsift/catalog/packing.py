"""Archives made from documents, for the queries over archives."""

from __future__ import annotations

import gzip
import tarfile
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarsift.session import ship_with_tasks
from tarsift.sources.tables import spread
from tarsift.views import table

ship_with_tasks(__name__)

SCHEMA = "path string, content binary"


def archives(spark, folder: str) -> DataFrame:
    """One archive per document, as (path, content); eight kinds by doc_id."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return spread(docs, "doc_id").mapInPandas(_pack, SCHEMA)


def _pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = [_archive(int(i), t) for i, t in zip(batch["doc_id"], batch["text"])]
        yield pd.DataFrame(rows, columns=["path", "content"])


def _archive(doc: int, text: str) -> tuple[str, bytes]:
    kind, data = doc % 8, text.encode()
    stem = f"@src__p{doc}" if kind == 7 else f"pkg{doc}"
    path = f"downloads/{stem}@1.0.{doc % 5}.tgz"
    if kind == 6:
        return path, data
    manifest = f'{{"name":"archive-made-from-document-{doc}"}}'.encode()
    places = {3: [], 4: ["zeta", "alpha"]}.get(kind, ["package"])
    members = [(f"{place}/package.json", manifest) for place in places]
    if kind == 0:  # replaced by later members of the same paths
        members = [("package/package.json", b"{}"), ("package/index.js", b"eval (old)"), *members]
    members.append(("package/index.js", data))
    if kind == 2:
        members.append(("../x", b"out"))
    if kind == 5:
        members += [("package/.npmrc", b"a=b"), ("package/package-lock.json", b"{}")]
    links = []
    if kind == 1:
        links = [
            ("package/out", tarfile.SYMTYPE, "/etc/passwd"),
            ("package/up", tarfile.LNKTYPE, "../up"),
            ("package/fine", tarfile.SYMTYPE, "index.js"),
            ("package/hard.js", tarfile.LNKTYPE, "package/index.js"),
            ("package/lib/soft.js", tarfile.SYMTYPE, "../hard.js"),
            ("package/gone.js", tarfile.SYMTYPE, "nowhere.js"),
        ]
    pieces = []
    for name, content in members:
        pieces += [_header(name, len(content)), content, bytes(-len(content) % tarfile.BLOCKSIZE)]
    pieces += [_header(name, 0, link, target) for name, link, target in links]
    # The end of an archive is two blocks of zeros; all of it is compressed at once.
    return path, gzip.compress(b"".join([*pieces, bytes(2 * tarfile.BLOCKSIZE)]), 1)


@lru_cache(4096)
def _header(name: str, size: int, kind: bytes = tarfile.REGTYPE, target: str = "") -> bytes:
    info = tarfile.TarInfo(name)
    info.size, info.type, info.linkname = size, kind, target
    return info.tobuf(tarfile.USTAR_FORMAT)


# The same archives in SQL: one row per archive, and one per member.
BASE_SQL = """
a AS (SELECT doc_id, doc_id % 8 AS k, text,
        CASE WHEN doc_id % 8 = 7 THEN concat('@src/p', doc_id) ELSE concat('pkg', doc_id) END AS name,
        concat('1.0.', doc_id % 5) AS version,
        concat('downloads/', CASE WHEN doc_id % 8 = 7 THEN '@src__p' ELSE 'pkg' END, doc_id, '@1.0.', doc_id % 5, '.tgz') AS archive,
        concat('{"name":"archive-made-from-document-', doc_id, '"}') AS manifest FROM documents),
m AS (
  SELECT a.*, 'package/package.json' AS path, 'file' AS kind, manifest AS content, CAST(NULL AS VARCHAR) AS linkname FROM a WHERE k NOT IN (3, 4, 6)
  UNION ALL SELECT a.*, 'zeta/package.json', 'file', manifest, NULL FROM a WHERE k = 4
  UNION ALL SELECT a.*, 'alpha/package.json', 'file', manifest, NULL FROM a WHERE k = 4
  UNION ALL SELECT a.*, 'package/index.js', 'file', text, NULL FROM a WHERE k <> 6
  UNION ALL SELECT a.*, 'package/.npmrc', 'file', 'a=b', NULL FROM a WHERE k = 5
  UNION ALL SELECT a.*, 'package/package-lock.json', 'file', '{}', NULL FROM a WHERE k = 5
  UNION ALL SELECT a.*, 'package/out', 'symlink', NULL, '/etc/passwd' FROM a WHERE k = 1
  UNION ALL SELECT a.*, 'package/up', 'hardlink', NULL, '../up' FROM a WHERE k = 1
  UNION ALL SELECT a.*, 'package/fine', 'symlink', text, 'index.js' FROM a WHERE k = 1
  UNION ALL SELECT a.*, 'package/hard.js', 'hardlink', text, 'package/index.js' FROM a WHERE k = 1
  UNION ALL SELECT a.*, 'package/lib/soft.js', 'symlink', text, '../hard.js' FROM a WHERE k = 1
  UNION ALL SELECT a.*, 'package/gone.js', 'symlink', NULL, 'nowhere.js' FROM a WHERE k = 1
  UNION ALL SELECT a.*, 'package/package.json', 'superseded', NULL, NULL FROM a WHERE k = 0
  UNION ALL SELECT a.*, 'package/index.js', 'superseded', NULL, NULL FROM a WHERE k = 0),
o AS (SELECT * FROM m WHERE k <> 2)"""
