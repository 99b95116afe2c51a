"""Open files inside tasks, by the paths Spark uses."""

from urllib.parse import quote

from pyarrow import fs

SCHEMES = {"s3a": "s3", "s3n": "s3"}


def locate(path: str) -> tuple[fs.FileSystem, str]:
    """Arrow file system and name for a Spark path.

    Spark writes ``file:/x`` and ``s3a://b/x``, without escapes, where Arrow
    wants an escaped ``file:///x`` and ``s3://b/x``; a plain path is local.
    """
    if ":/" not in path:
        path = "file:" + path
    scheme, rest = path.split(":", 1)
    if not rest.startswith("//"):
        rest = "//" + rest
    return fs.FileSystem.from_uri(f"{SCHEMES.get(scheme, scheme)}:{quote(rest, safe='/:@')}")
