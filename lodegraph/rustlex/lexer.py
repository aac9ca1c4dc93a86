"""Tokens of a Rust text with their lines, and the partner of each bracket."""

from __future__ import annotations

import re
from dataclasses import dataclass

KEYWORDS = frozenset("as async await break const continue crate dyn else enum extern fn for if impl in let loop match mod move mut pub ref return self Self static struct super trait type union unsafe use where while".split())
_TOKEN = re.compile(
    r"(?P<skip>\s+|//[^\n]*)|(?P<block>/\*)|(?P<str>(?:br|cr|r)(?P<h>#*)\"[\s\S]*?\"(?P=h)|[bc]?\"(?:[^\"\\]|\\[\s\S])*\")|(?P<char>b?'(?:[^'\\\n]|\\[^\n]+?)')|(?P<life>'[^\W\d]\w*)"
    r"|(?P<num>\d[\w]*(?:\.\d[\w]*)?)|(?P<id>(?:r#)?[^\W\d]\w*)|(?P<op>::|->|=>|\.\.=|\.\.\.|\.\.|&&|\|\||[=!<>+\-*/%^&|]=|[\s\S])"
)
_OPEN, _CLOSE = {"(": ")", "[": "]", "{": "}"}, {")", "]", "}"}


@dataclass
class Tokens:
    """kind, text and line of each token; partner: index of the matching bracket (the end of the text for one that is never closed); errors: brackets without partner and characters that start nothing."""

    kind: list[str]
    text: list[str]
    line: list[int]
    partner: dict[int, int]
    errors: int

    def __len__(self) -> int:
        return len(self.text)


def _block_end(text: str, at: int) -> int:
    depth = 0
    for m in re.compile(r"/\*|\*/").finditer(text, at):
        depth += 1 if m.group() == "/*" else -1
        if not depth:
            return m.end()
    return len(text)


def tokens(text: str) -> Tokens:
    kind, texts, lines, partner, errors = [], [], [], {}, 0
    stack: list[int] = []
    at, line = 0, 1
    while at < len(text):
        m = _TOKEN.match(text, at)
        k = m.lastgroup if m.lastgroup != "h" else "str"
        end = _block_end(text, at) if k == "block" else m.end()
        piece = text[at:end]
        if k not in ("skip", "block"):
            i = len(texts)
            kind.append(k)
            texts.append(piece.removeprefix("r#") if k == "id" else piece)
            lines.append(line)
            if k == "op":
                if piece in _OPEN:
                    stack.append(i)
                elif piece in _CLOSE:
                    while stack and _OPEN[texts[stack[-1]]] != piece and any(_OPEN[texts[s]] == piece for s in stack):
                        stack.pop()
                        errors += 1
                    if stack and _OPEN[texts[stack[-1]]] == piece:
                        partner[i] = stack[-1]
                        partner[stack.pop()] = i
                    else:
                        errors += 1
                elif piece in ("\\", "`", '"', "�"):
                    errors += 1
        line += piece.count("\n")
        at = end
    for s in stack:
        partner[s] = len(texts)
        errors += 1
    return Tokens(kind, texts, lines, partner, errors)
