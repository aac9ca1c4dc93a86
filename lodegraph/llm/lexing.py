"""Texts to strings with one character per token, from any lexer state.

A state says what is open where a text starts: code, a comment, a string or a
template that goes on from the text before, which brackets enclose it as far as
that is known (only those matter that decide how a ``}`` or a ``/`` is read),
and whether a value has just ended.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from typing import NamedTuple

#: Not a token of the language; and what only the slow path can read on from.
BAD, SPECIAL = "\x00", "\x01"
#: Brackets around the substitutions of a template.
SUB_OPEN, SUB_CLOSE = "«", "»"


class State(NamedTuple):
    """mode: code, comment (``arg``: depth), string (``arg``: the closing text) or template. stack: known brackets around, innermost last."""

    mode: str = "code"
    arg: str = ""
    stack: str = ""
    value: bool = False


CODE = State()


class Lexemes(dict):
    """Token text to character. Words, numbers and quoted texts are told by their look and remembered."""

    def __init__(self, fixed: dict[str, str], other: Callable[[str], str]):
        super().__init__(fixed)
        self._other, self._room = other, 200_000

    def __missing__(self, token: str) -> str:
        c = self._other(token)
        if self._room and len(token) < 40:
            self._room -= 1
            self[token] = c
        return c


def alphabet(words: str, signs: str) -> dict[str, str]:
    """A character for each word and sign; signs of one character stand for themselves."""
    return {t: t if len(t) == 1 and not t.isalnum() and t != "_" else chr(0x100 + k) for k, t in enumerate((words + " " + signs).split())}


_SPACE = r"[^\S\n]+|﻿"
_BLOCK = r"/\*(?:[^*]|\*(?!/))*+\*/"
_WORD = r"[^\W\d]\w*"
_NUMBER = r"0[xX][\da-fA-F_]+|0[bB][01_]+|0[oO][0-7_]+|\d[\d_]*(?:\.(?![.\w])|\.\d[\d_]*)?(?:[eE][+-]?[\d_]*\d[\d_]*)?"
_STRING = r'"(?:[^"\\\n]|\\[\s\S])*+"'
_QUOTED = r"'(?:[^'\\\n]|\\[\s\S])*+'"


class Lexer:
    """One language. ``token`` finds the next token after blanks and comments; SPECIAL tokens open what no token can hold whole."""

    token: re.Pattern
    lexemes: Lexemes

    def fast(self, text: str) -> str | None:
        """The tokens of a text that leaves nothing open, None where a closer look is needed."""
        s = "".join(map(self.lexemes.__getitem__, self.token.findall(text)))
        return None if SPECIAL in s else s

    def special(self, token: str) -> State:
        """The state that a special token opens."""
        raise NotImplementedError

    def closes(self, arg: str) -> re.Pattern:
        """What a string goes on with up to its end."""
        raise NotImplementedError

    def resume(self, text: str, at: int, state: State) -> tuple[int, str, State]:
        """(where code goes on, tokens that end there, state); -1 where the text ends first."""
        if state.mode == "comment":
            end = text.find("*/", at)
            return (end + 2, "", CODE) if end >= 0 else (-1, "", state)
        m = self.closes(state.arg).match(text, at)
        return (m.end(), "s", CODE) if m else (-1, "", state)

    def lex(self, text: str, state: State = CODE, last: bool = False) -> tuple[str, State]:
        """(tokens, state at the end, which is of no use after the last piece of a text)."""
        if state.mode == "code":
            s = self.fast(text)
            if s is not None:
                return s, CODE
        return self.slow(text, state)

    def slow(self, text: str, state: State) -> tuple[str, State]:
        out, at, match, lexemes = [], 0, self.token.match, self.lexemes
        while True:
            if state.mode != "code":
                at, s, state = self.resume(text, at, state)
                out.append(s)
                if at < 0:
                    return "".join(out), state
            while at < len(text):
                m = match(text, at)
                c = lexemes[m.group(1)]
                at = m.end()
                if c == SPECIAL:
                    state = self.special(m.group(1))
                    break
                out.append(c)
            else:
                return "".join(out), CODE


# --- Rust -------------------------------------------------------------------

#: fixed values: the words of the language; those of the last line are names elsewhere
RUST_STRICT = "as break const continue crate else enum extern fn for if impl in let loop match mod move mut pub ref return self Self static struct super trait type unsafe use where while async await dyn _"
RUST_LITERAL, RUST_RESERVED = "true false", "abstract become box do final macro override priv typeof unsized virtual yield try"
RUST_LOOSE = "union auto default raw safe"
RUST = alphabet(f"{RUST_STRICT} {RUST_LOOSE}", ":: -> => .. ..= ... == != && || <= <<= ( ) [ ] { } ; , : . = + - * / % ^ & | < > ! ? # $ @ ~") | {
    "op=": chr(0x250), "< glued": chr(0x251), "> glued": chr(0x252), "doc comment": chr(0x253), "inner doc comment": chr(0x254), "reserved word": chr(0x255), "lifetime name": chr(0x256), "<<=": chr(0x250)}


def _rust_other(t: str) -> str:
    c = t[0]
    if t in ("/*", "/**", "/*!"):
        return SPECIAL
    if t.startswith(("///", "/**")):
        return RUST["doc comment"]
    if t.startswith(("//!", "/*!")):
        return RUST["inner doc comment"]
    if t[-1] == '"' and t.strip("bcr#") == '"':
        return SPECIAL
    if len(t) > 1 and t[-1] in "\"#" and '"' in t or c == "'" and t[-1] == "'" and len(t) > 2 or c == "b" and t[-1] == "'":
        return "s"
    if c == "'" and len(t) > 1:
        return RUST["lifetime name"]
    if c.isalpha() or c == "_":
        return "i"
    if c.isdigit():
        return "n"
    return BAD


_NESTING = re.compile(r"/\*|\*/")


class RustLexer(Lexer):
    _doc = r"///(?!/)[^\n]*|//![^\n]*|/\*[*!](?![*/])(?:[^*/]|\*(?!/)|/(?!\*))*+\*/|/\*[*!](?![*/])"
    _plain = r"/\*(?![*!])(?:[^*/]|\*(?!/)|/(?!\*))*+\*/|/\*\*/|/\*\*\*(?:[^*/]|\*(?!/)|/(?!\*))*+\*/"
    token = re.compile(
        rf"(?:{_SPACE}|\n|//(?![/!])[^\n]*|////[^\n]*|{_plain})*+"
        rf"({_doc}|/\*|[bc]?r\"[^\"]*+\"|[bc]?r#\"(?:[^\"]|\"(?!#))*+\"#|[bc]?r##\"(?:[^\"]|\"(?!##))*+\"##|[bc]?r#*\"|[bc]?\"(?:[^\"\\]|\\[\s\S])*+\"|[bc]?\""
        rf"|b?'(?:[^'\\\n]|\\[^\n]+?)'|'{_WORD}|r#{_WORD}|(?:{_NUMBER})(?:_?(?:[iu](?:8|16|32|64|128|size)|f16|f32|f64|f128))?(?!\w)|{_WORD}"
        rf"|::|->|=>|\.\.[.=]?|==|!=|<<=|<=|<<|>>=(?!>)|>=(?!>)|>>|&&|\|\||[+\-*/%^&|]=|[\s\S]|\Z)"
    )
    lexemes = Lexemes(
        RUST | {"<<": RUST["< glued"] + "<", ">>": RUST["> glued"] + ">", ">=": RUST["> glued"] + "=", ">>=": RUST["> glued"] * 2 + "="} | dict.fromkeys(RUST_LITERAL.split(), "n") | dict.fromkeys(RUST_RESERVED.split(), RUST["reserved word"]) | {"": "", "\n": ""} | {x: RUST["op="] for x in "+= -= *= /= %= ^= &= |= <<=".split()},
        _rust_other,
    )

    def special(self, token: str) -> State:
        if token.startswith("/*"):
            return State("comment", "1")
        return State("string", '"' + "#" * token.count("#") if "r" in token else "\\")

    def closes(self, arg: str) -> re.Pattern:
        return re.compile(r'(?:[^"\\]|\\[\s\S])*+"' if arg == "\\" else rf'(?:[^"]|"(?!{arg[1:]}))*+{arg}' if len(arg) > 1 else '[^"]*"')

    def resume(self, text: str, at: int, state: State) -> tuple[int, str, State]:
        if state.mode != "comment":
            return super().resume(text, at, state)
        depth = int(state.arg)
        for m in _NESTING.finditer(text, at):
            depth += 1 if m.group() == "/*" else -1
            if not depth:
                return m.end(), "", CODE
        return -1, "", State("comment", str(depth))


# --- JavaScript and TypeScript ----------------------------------------------

#: fixed values: the words of the languages; those of the second line are names elsewhere
JS_STRICT = "function class const var if else for while do switch case default return throw break continue debugger new typeof void delete instanceof in try catch finally import export extends with enum this super null true false"
JS_LOOSE = "let async await yield get set static of from as accessor target meta interface type namespace declare abstract readonly private public protected override keyof infer unique asserts module global is satisfies implements out using"
JS = alphabet(f"{JS_STRICT} {JS_LOOSE}", "=> ... ?. ++ -- ?? && || ** == != === !== <= << ( ) [ ] { } ; , : . = + - * / % ^ & | < > ! ? ~ @") | {"op=": chr(0x250), "> glued": chr(0x251), "private name": chr(0x252), "regex literal": chr(0x253), "template literal": chr(0x254), "\n": "\n"}
#: What a value can end with, so that a ``/`` after it divides.
_JS_VALUE = frozenset("insi)]}" + JS["private name"] + JS["regex literal"] + JS["template literal"] + SUB_CLOSE + "".join(JS[w] for w in f"this super null true false {JS_LOOSE}".split()) + JS["++"] + JS["--"]) - frozenset(JS[w] for w in ("await", "yield", "of"))
_JS_HEADS = frozenset(JS[w] for w in "if while for with".split())


def _js_other(t: str) -> str:
    c = t[0]
    if c == "`":
        return JS["template literal"] if len(t) > 1 else SPECIAL
    if len(t) > 1 and c in "\"'":
        return "s"
    if c == "#" and len(t) > 1:
        return JS["private name"]
    if c.isalpha() or c in "_$\\":
        return "i"
    if c.isdigit() or c == "." and len(t) > 1:
        return "n"
    return SPECIAL if t == "/*" else BAD


class JsLexer(Lexer):
    _word = r"(?:[^\W\d]|[$\\])(?:[\w$]|\\u(?:[0-9a-fA-F]{4}|\{[0-9a-fA-F]+\})|[‌‍])*+"
    token = re.compile(
        rf"(?:{_SPACE}|//[^\n]*|{_BLOCK})*+(/\*|`(?:[^`\\$]|\\[\s\S]|\$(?!\{{))*+`|{_STRING}|{_QUOTED}|(?:0[xX][\da-fA-F_]+|0[bB][01_]+|0[oO][0-7_]+|\d[\d_]*(?:\.[\d_]*)?(?:[eE][+-]?\d[\d_]*)?|\.\d[\d_]*(?:[eE][+-]?\d[\d_]*)?)n?(?![\w$])"
        rf"|#?{_word}|===|!==|==|!=|=>|\.\.\.|\?\.(?!\d)|\?\?=?|&&=?|\|\|=?|\*\*=?|\+\+|--|<<=?|<=|>>>=(?!>)|>>=(?!>)|>=(?!>)|>>>|>>|[+\-*/%&|^]=|[\s\S]|\Z)"
    )
    regex = re.compile(r"/(?![/*])(?:[^/\\\[\n]|\\[^\n]|\[(?:[^\]\\\n]|\\[^\n])*+\])++/[A-Za-z]*")
    _chunk = re.compile(r"(?:[^`\\$]|\\[\s\S]|\$(?!\{))*+(`|\$\{)")
    lexemes = Lexemes(JS | {"": "", "#": BAD} | {t: JS["> glued"] * (len(t) - 1) + t[-1] for t in (">>", ">>>", ">=", ">>=", ">>>=")} | {x: JS["op="] for x in "??= &&= ||= **= += -= *= /= %= &= |= ^= <<=".split()}, _js_other)
    _slashes = frozenset("/" + JS["op="])

    def fast(self, text: str) -> str | None:
        found = self.token.findall(text)
        s = "".join(map(self.lexemes.__getitem__, found))
        if SPECIAL in s or "/" in s and self._regex_in(s) or "/=" in found:
            return None
        return s

    @staticmethod
    def _regex_in(s: str) -> bool:
        """Whether some slash may start a regular expression."""
        before = ""
        for part in s.split("/")[:-1]:
            before = part.rstrip("\n")[-1:] or before
            if before not in _JS_VALUE or before in ")}":
                return True
        return False

    def lex(self, text: str, state: State = CODE, last: bool = False) -> tuple[str, State]:
        """In the state at the end, ``arg`` counts the unknown brackets that were closed, each taken for a plain one."""
        if state.mode == "code" and SUB_OPEN not in state.stack:
            s = self.fast(text)
            if s is not None:
                return s, CODE if last else self._after(s, state)
        return self.slow(text, state)

    def _after(self, s: str, state: State) -> State:
        stack, closed, before, value = list(state.stack), int(state.arg or 0), "", state.value
        for c in s:
            if c == "\n":
                continue
            value = c in _JS_VALUE and c != "}"
            if c in "([{":
                stack.append("k" if c == "(" and before in _JS_HEADS else c)
            elif c in ")]}":
                if not stack:
                    closed += 1
                elif stack.pop() == "k":
                    value = False
            before = c
        return State("code", str(closed), "".join(stack), value)

    def slow(self, text: str, state: State) -> tuple[str, State]:
        out: list[str] = []
        mode, stack, value, at, n = state.mode, list(state.stack), state.value, 0, len(text)
        closed, match, lexemes, before = int(state.arg or 0), self.token.match, self.lexemes, ""
        while True:
            if mode == "comment":
                end = text.find("*/", at)
                if end < 0:
                    break
                at, mode = end + 2, "code"
            elif mode == "template":
                m = self._chunk.match(text, at)
                if not m:
                    break
                at, mode = m.end(), "code"
                value = m.group(1) == "`"
                before = JS["template literal"] if value else SUB_OPEN
                out.append(before)
                if not value:
                    stack.append(SUB_OPEN)
            while at < n:
                m = match(text, at)
                token, at = m.group(1), m.end()
                c = lexemes[token]
                if c == "\n":
                    out.append(c)
                    continue
                if c == SPECIAL:
                    mode = "comment" if token == "/*" else "template"
                    break
                if token in ("/", "/=") and not value:
                    r = self.regex.match(text, m.start(1))
                    if r:
                        c, at = JS["regex literal"], r.end()
                if token in ("(", "[", "{"):
                    stack.append("k" if token == "(" and before in _JS_HEADS else token)
                    value = False
                elif token in (")", "]", "}"):
                    closed += not stack
                    top = stack.pop() if stack else ""
                    value = token == "]" or token == ")" and top != "k"
                    if token == "}" and top == SUB_OPEN:
                        out.append(SUB_CLOSE)
                        mode = "template"
                        break
                elif c:
                    value = c[-1] in _JS_VALUE
                out.append(c)
                before = c or before
            else:
                break
        return "".join(out), State(mode, str(closed), "".join(stack), value)


# --- Go -----------------------------------------------------------------------

GO_WORDS = "package import func type struct interface map chan var const if else for range switch select case default return break continue goto fallthrough go defer"
GO = alphabet(GO_WORDS, ":= ... <- &^ && || ++ -- == != <= >= << >> ( ) [ ] { } ; , : . = + - * / % ^ & | < > ! ~") | {"op=": chr(0x250), "\n": "\n"}


def _go_other(t: str) -> str:
    c = t[0]
    if t in ("/*", "`"):
        return SPECIAL
    if len(t) > 1 and c in "\"'`":
        return "s"
    if c.isalpha() or c == "_":
        return "i"
    return "n" if c.isdigit() or c == "." and len(t) > 1 else BAD


class GoLexer(Lexer):
    token = re.compile(
        rf"(?:{_SPACE}|//[^\n]*|/\*(?:[^*\n]|\*(?!/))*+\*/)*+(/\*|`[^`]*`|`|{_STRING}|{_QUOTED}|(?:0[xX][\da-fA-F_]*(?:\.[\da-fA-F_]*)?(?:[pP][+-]?\d+)?|0[bB][01_]+|0[oO][0-7_]+|\d[\d_]*(?:\.[\d_]*)?(?:[eE][+-]?\d[\d_]*)?|\.\d[\d_]*(?:[eE][+-]?\d[\d_]*)?)i?(?!\w)"
        rf"|{_WORD}|:=|\.\.\.|<-|&\^=?|&&|\|\||\+\+|--|==|!=|<=|>=|<<=?|>>=?|[+\-*/%&|^]=|[\s\S]|\Z)"
    )
    lexemes = Lexemes(GO | {"": ""} | {x: GO["op="] for x in "+= -= *= /= %= &= |= ^= <<= >>= &^=".split()}, _go_other)

    def special(self, token: str) -> State:
        return State("comment") if token == "/*" else State("string", "`")

    def closes(self, arg: str) -> re.Pattern:
        return re.compile(r"[^`]*`")

    def resume(self, text: str, at: int, state: State) -> tuple[int, str, State]:
        """A comment over several lines ends a line; one that goes on from the text before did so there."""
        end, s, after = super().resume(text, at, state)
        if state.mode == "comment" and end >= 0 and (not at or "\n" in text[at:end]):
            s = "\n"
        return end, s, after


LEXERS: dict[str, Lexer] = {"rust": RustLexer(), "javascript": JsLexer(), "typescript": JsLexer(), "go": GoLexer()}
