"""URI references by RFC 3986: parts, resolution, and JSON Pointer fragments."""

from __future__ import annotations

import re
from urllib.parse import unquote

_PARTS = re.compile(r"(?:([^:/?#]+):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?", re.S)
_PLAIN = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-._~!$&'()*+,;=:@/?")


def parts(uri: str) -> tuple[str | None, str | None, str, str | None, str | None]:
    """scheme, authority, path, query, fragment; None where a part is absent."""
    return _PARTS.fullmatch(uri).groups()


def join(scheme: str | None, authority: str | None, path: str, query: str | None, fragment: str | None) -> str:
    return (f"{scheme}:" if scheme is not None else "") + (f"//{authority}" if authority is not None else "") + path + (f"?{query}" if query is not None else "") + (f"#{fragment}" if fragment is not None else "")


def without_dots(path: str) -> str:
    out: list[str] = []
    rest = path.split("/")
    for i, s in enumerate(rest):
        last = i == len(rest) - 1
        if s == ".." :
            if len(out) > 1 or (out and out[0] != ""):
                out.pop()
            if last:
                out.append("")
        elif s == ".":
            if last:
                out.append("")
        else:
            out.append(s)
    if path.startswith("/") and (not out or out[0] != ""):
        out.insert(0, "")
    return "/".join(out)


def resolve(base: str, reference: str) -> str:
    """The target of a reference seen at ``base``, its fragment kept."""
    scheme, authority, path, query, fragment = parts(reference)
    if scheme is not None:
        return join(scheme, authority, without_dots(path) if authority is not None or path.startswith("/") else path, query, fragment)
    b_scheme, b_authority, b_path, b_query, _ = parts(base)
    if authority is not None:
        return join(b_scheme, authority, without_dots(path), query, fragment)
    if path == "":
        return join(b_scheme, b_authority, b_path, query if query is not None else b_query, fragment)
    if not path.startswith("/"):
        if b_authority is not None and b_path == "":
            path = "/" + path
        else:
            path = b_path[: b_path.rfind("/") + 1] + path
    return join(b_scheme, b_authority, without_dots(path), query, fragment)


def defragged(uri: str) -> tuple[str, str | None]:
    head, mark, fragment = uri.partition("#")
    return head, fragment if mark else None


def encoded(pointer: str) -> str:
    """A pointer as a URI fragment: all but fragment characters percent-encoded."""
    return "".join(c if c in _PLAIN else "".join(f"%{b:02X}" for b in c.encode()) for c in pointer)


def decoded(fragment: str) -> str:
    return unquote(fragment, errors="strict") if "%" in fragment else fragment
