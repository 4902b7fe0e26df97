"""JSON texts of any depth, read with an explicit stack: validity, the nodes of a tree, pruning."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

_SKIP = re.compile(r"[ \t\n\r]*")
_STRING = re.compile(r'"[^"\\\x00-\x1f]*(?:\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4})[^"\\\x00-\x1f]*)*"')
_PLAIN = re.compile(r"-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?|true|false|null")
#: Values nested deeper than this below a node, or in a pruned text, are read as null.
MOST = 400


def events(text: str) -> Iterator[tuple[str, int, int, str]]:
    """(event, start, end, key) of one JSON value; ValueError where the text is none as a whole.

    Events: { [ - a container opens, } ] - it closes (start is that of its opening), v - any
    other value. key is that of the member of an object, else "".
    """
    stack: list[tuple[str, int, str]] = []
    i = _SKIP.match(text).end()
    while True:
        # a value
        key, at = "", i
        if stack and stack[-1][0] == "{":
            m = _STRING.match(text, i)
            if not m:
                raise ValueError(i)
            key = json.loads(m[0]) if "\\" in m[0] else m[0][1:-1]
            i = _SKIP.match(text, m.end()).end()
            if text[i : i + 1] != ":":
                raise ValueError(i)
            at = i = _SKIP.match(text, i + 1).end()
        c = text[i : i + 1]
        if c and c in "{[":
            yield c, at, at + 1, key
            stack.append((c, at, key))
            i = _SKIP.match(text, i + 1).end()
            if text[i : i + 1] != ("}" if c == "{" else "]"):
                continue
        else:
            m = (_STRING if c == '"' else _PLAIN).match(text, i)
            if not m:
                raise ValueError(i)
            yield "v", at, m.end(), key
            i = _SKIP.match(text, m.end()).end()
        # what follows a value
        while stack and text[i : i + 1] == ("}" if stack[-1][0] == "{" else "]"):
            _, start, key = stack.pop()
            yield text[i], start, i + 1, key
            i = _SKIP.match(text, i + 1).end()
        if not stack:
            if i < len(text):
                raise ValueError(i)
            return
        if text[i : i + 1] != ",":
            raise ValueError(i)
        i = _SKIP.match(text, i + 1).end()


def is_whole(text: str) -> bool:
    """Whether a text is one valid JSON value as a whole."""
    try:
        for _ in events(text):
            pass
    except ValueError:
        return False
    return True


def tree_nodes(text: str) -> list[tuple[str, str, str]]:
    """(path, path of the parent, JSON of the node without its children) of a valid text, children first.

    Of repeated keys in one object the last counts.
    """
    out: list[tuple[str, str, str]] = []
    # per open container: what it is (doc, node, list of nodes or other), entries so far, members of a node,
    # rows before those of its tree or children
    stack: list[list] = []
    at: list[str] = []
    deepest = 0
    for event, start, end, key in events(text):
        if event in "{[v":
            up = stack[-1] if stack else None
            if up is None:
                kind = "doc" if event == "{" else "other"
            elif (up[0] == "doc" and key == "tree") or (up[0] == "node" and key == "children"):
                kind, index = ("node", 0) if event == "{" else ("list", 0)
                del out[up[3] if up[3] is not None else len(out) :]
                up[3] = len(out)
            elif up[0] == "list":
                kind, index = "node" if event == "{" else "other", up[1]
                up[1] += 1
            else:
                kind = "other"
            if event == "v":
                if up and up[0] == "node" and key != "children":
                    up[2].append(f"{json.dumps(key)}:{text[start:end]}")
                continue
            if kind == "node":
                at.append(str(index))
            if up and up[0] == "node":
                deepest = len(stack)
            stack.append([kind, 0, [], None])
            deepest = max(deepest, len(stack))
            continue
        kind, _, members, _ = stack.pop()
        if kind == "node":
            out.append((".".join(at), ".".join(at[:-1]), "{" + ",".join(members) + "}"))
            at.pop()
        elif kind == "other" and stack and stack[-1][0] == "node":
            stack[-1][2].append(f"{json.dumps(key)}:{text[start:end] if deepest - len(stack) <= MOST else 'null'}")
    return out


def pruned(text: str) -> str:
    """A valid text with null for what is nested deeper than MOST levels."""
    out, done, depth, cut = [], 0, 0, 0
    for event, start, end, _ in events(text):
        if event in "{[":
            depth += 1
            if depth == MOST + 1:
                cut = start
        elif event in "}]":
            depth -= 1
            if depth == MOST:
                out += [text[done:cut], "null"]
                done = end
    return "".join([*out, text[done:]])
