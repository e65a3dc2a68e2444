"""Files that Python tasks open themselves, through the file system that their URI names."""

from __future__ import annotations

import re

# Names under which Hadoop's file systems go elsewhere.
SCHEMES = {"s3a": "s3", "s3n": "s3"}


def file_system(uri: str):
    """The file system of a URI, and the path in it; a path without a scheme is local."""
    from pyarrow import fs

    scheme, mark, rest = uri.partition(":")
    if not mark or "/" in scheme:
        return fs.FileSystem.from_uri(f"file://{uri}")
    uri = f"{SCHEMES.get(scheme, scheme)}:{rest}"
    return fs.FileSystem.from_uri(re.sub("^file:/+", "file:///", uri))
