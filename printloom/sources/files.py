"""Names of documents that are files."""

from __future__ import annotations

import re


def document_name(file: str, path: str) -> str:
    """The file's path below what was asked for (a folder, or the folders before a pattern), without its ending.

    So files of one name in two folders are two documents. A file asked for by its own path has its bare name.
    """
    pattern = re.search(r"[*?\[{]", path)
    root = path[: pattern.start()].rpartition("/")[0] if pattern else path.rstrip("/")
    root = re.sub(r"^[a-z][a-z0-9+.-]*:/*", "/", root)
    at = file.find(root + "/") if root else -1
    name = file[at + len(root) + 1 :] if at >= 0 else file.rsplit("/", 1)[-1]
    return re.sub(r"\.[^./]*$", "", name)
