"""ZIP archives of files: the same files give the same bytes."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Mapping


def pack(files: Mapping[str, bytes], level: int = 6) -> bytes:
    """An archive of files by path, in the order of their paths, with a fixed time; leading slashes are dropped."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED, compresslevel=level) as z:
        for path in sorted(files):
            z.writestr(zipfile.ZipInfo(path.lstrip("/"), (1980, 1, 1, 0, 0, 0)), files[path], zipfile.ZIP_DEFLATED, level)
    return out.getvalue()


def unpack(data: bytes) -> dict[str, bytes]:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        return {n: z.read(n) for n in z.namelist() if not n.endswith("/")}
