"""Files reached by their address from the driver and from executors."""

from __future__ import annotations

import re


def filesystem(uri: str):  # noqa: ANN201
    """pyarrow's file system and the path in it, for a URI or a local path."""
    from pyarrow import fs

    if not re.match(r"\w[\w+.-]+:", uri):
        return fs.LocalFileSystem(), uri
    if m := re.match(r"file:/*(/.*)", uri):
        return fs.LocalFileSystem(), m[1]
    return fs.FileSystem.from_uri(re.sub(r"^s3[an]:", "s3:", uri))
