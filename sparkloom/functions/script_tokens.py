"""JavaScript and TypeScript as tokens, with a table of bracket partners; one pass over the text.

No parser for these languages is at hand. Tokens are enough for a canonical form that tells
literals, white space and comments apart, for the ends of functions and classes, and to refuse
texts that no parser could accept. Text inside of markup is not told from code; where markup is
met, nothing is refused.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from dataclasses import dataclass, field

_NAME_FIRST, _NAME = r"(?:[^\W\d]|\$|\\u[\da-fA-F]{4}|\\u\{[\da-fA-F]+\})", r"(?:[\w$\u200c\u200d]|\\u[\da-fA-F]{4}|\\u\{[\da-fA-F]+\})"
#: Words behind which a slash begins a regular expression, and those whose brackets hold a condition, not an operand.
_BEFORE_REGEX = frozenset(("return", "typeof", "case", "in", "of", "delete", "void", "throw", "new", "else", "do", "instanceof", "yield", "await"))
_CONDITIONS = frozenset(("if", "while", "for", "with"))
#: Words behind which a line break ends a statement, so it tells two texts apart.
_RESTRICTED = frozenset(("return", "break", "continue", "throw", "yield"))
_TOKEN = re.compile(
    rf"""(?P<space>\s+)
    |(?P<comment>//[^\n\r\u2028\u2029]*|/\*.*?\*/)
    |(?P<string>'(?:\\\r\n|\\.|[^'\\\n\r])*'|"(?:\\\r\n|\\.|[^"\\\n\r])*")
    |(?P<number>0[xXbBoO][\da-fA-F_]+n?|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d+)?n?)
    |(?P<name>[#@]?{_NAME_FIRST}{_NAME}*)
    |(?P<mark>>>>=|\.\.\.|===|!==|\*\*=|<<=|>>=|&&=|\|\|=|\?\?=|=>|==|!=|<=|&&|\|\||\?\?|\?\.(?!\d)|\+\+|--|\+=|-=|\*=|/=|%=|&=|\|=|\^=|\*\*|<<|[{{}}()\[\];,<>+\-*/%&|^!~?:=.])
    """,
    re.VERBOSE | re.DOTALL,
)
_REGEX = re.compile(r"/(?:\\[^\n\r]|\[(?:\\[^\n\r]|[^\]\\\n\r])*\]|[^/\\\[\n\r])+/[A-Za-z]*")
_OPENS, _CLOSES = frozenset("([{"), {")": "(", "]": "[", "}": "{"}
#: Marks that have an operand on both sides; those behind which a line goes on, and before which it does.
_BINARY = frozenset(("=", "==", "===", "!=", "!==", "+=", "-=", "*=", "%=", "&&", "||", "??", "&&=", "||=", "??="))
_GOES_ON = _BINARY | frozenset(("=>", "<", ">", "<=", "+", "-", "*", "/", "%", "&", "|", "^", "!", "~", "?", ":", ".", "?.", ",", "**", "<<", ">>=", "<<=", "/=", "..."))
_HELD = _GOES_ON - frozenset(("!", "~", "...", ","))
_LINE_END = re.compile(r"[\n\r\u2028\u2029]")


@dataclass
class Tokens:
    """Kinds, places and bracket partners (-1: none) of all tokens but space and comments.

    `blank` is the text with comments and literals blanked out but for their line feeds.
    `complete` is False where a literal does not end or a character fits nowhere; such a
    character stands as a mark of its own. `matched` says that all brackets have partners."""

    source: str
    kind: list[str] = field(default_factory=list)
    start: list[int] = field(default_factory=list)
    end: list[int] = field(default_factory=list)
    partner: list[int] = field(default_factory=list)
    complete: bool = True
    matched: bool = True
    markup: bool = False
    blank: str = ""

    def text(self, i: int) -> str:
        return self.source[self.start[i] : self.end[i]]

    def at(self, place: int) -> int:
        """The first token from a place of the text on."""
        return bisect_left(self.start, place)

    def breaks_before(self, i: int) -> bool:
        return i > 0 and _LINE_END.search(self.source, self.end[i - 1], self.start[i]) is not None


def _template(source: str, at: int) -> int:
    """Behind the template literal that begins at `at`; -1 where it does not end. Nested ones are kept on a stack."""
    stack, i = ["`"], at + 1
    while i < len(source):
        c = source[i]
        if stack[-1] == "`":
            if c == "\\":
                i += 2
                continue
            if c == "`":
                stack.pop()
                if not stack:
                    return i + 1
            elif source.startswith("${", i):
                stack.append("{")
                i += 1
        elif c in "'\"/":
            m = _TOKEN.match(source, i)
            if m and m.lastgroup in ("string", "comment"):
                i = m.end()
                continue
        elif c == "`" or c == "{":
            stack.append(c)
        elif c == "}":
            stack.pop()
        i += 1
    return -1


def scan(source: str | None) -> Tokens:
    """All tokens in one pass. A slash begins a regular expression where no operand stands before it."""
    source = source or ""
    t = Tokens(source)
    texts: list[str] = []
    open_: list[int] = []
    blank: list[str] = []
    at = copied = 0
    if source.startswith("#!"):
        at = (m.start() if (m := _LINE_END.search(source)) else len(source))

    def hide(end: int) -> None:
        nonlocal copied
        blank.append(source[copied:at])
        blank.append(re.sub(r"[^\n]", " ", source[at:end]))
        copied = end

    def operand() -> bool:
        """Whether what stands before is one, so that a slash divides it and `<` compares it."""
        if not texts:
            return False
        kind, text = t.kind[-1], texts[-1]
        member = len(texts) > 1 and texts[-2] in (".", "?.")
        if kind == "name":
            return member or text not in _BEFORE_REGEX
        if text == ")":
            p = t.partner[-1]
            return not (p > 0 and texts[p - 1] in _CONDITIONS and not (p > 1 and texts[p - 2] in (".", "?.")))
        if text == "}":  # a block's end, unless what it opens stands where an operand does
            p = t.partner[-1]
            return p > 0 and (texts[p - 1] in ("(", "[", ",", "?", ":", "return", "typeof") or texts[p - 1] in _BINARY)
        return kind in ("string", "number", "template", "regex") or text in ("]", "++", "--")

    def add(kind: str, end: int) -> None:
        nonlocal at
        text = source[at:end]
        i = len(t.kind)
        t.kind.append(kind)
        t.start.append(at)
        t.end.append(end)
        t.partner.append(-1)
        texts.append(text)
        if kind == "mark":
            if text in _OPENS:
                open_.append(i)
            elif text in _CLOSES:
                if open_ and texts[open_[-1]] == _CLOSES[text]:
                    t.partner[i] = open_.pop()
                    t.partner[t.partner[i]] = i
                else:
                    t.matched = False
        at = end

    while at < len(source):
        c = source[at]
        if c == "`":
            end = _template(source, at)
            if end > 0:
                hide(end)
                add("template", end)
                continue
        elif c == "/" and source[at + 1 : at + 2] not in ("/", "*") and not (texts and texts[-1] == "<") and not operand():
            if m := _REGEX.match(source, at):
                hide(m.end())
                add("regex", m.end())
                continue
        elif c == "<" and re.match(r"[A-Za-z_$/>]", source[at + 1 : at + 2]) and (source[at + 1] == "/" or not operand()):
            t.markup = True
        m = _TOKEN.match(source, at)
        if m is None:
            t.complete = False
            add("mark", at + 1)
        elif m.lastgroup == "space":
            at = m.end()
        elif m.lastgroup == "comment":
            hide(m.end())
            at = m.end()
        else:
            if source.startswith("/*", at):
                t.complete = False  # a comment without an end
            if m.lastgroup == "string":
                hide(m.end())
            add(m.lastgroup, m.end())
    t.matched &= not open_
    blank.append(source[copied:])
    t.blank = "".join(blank)
    return t


def canonical(source: str | None) -> str:
    """The tokens, one a line, with a mark for line breaks that end a statement; the squeezed text where it has no tokens."""
    t = scan(source)
    if not t.complete:
        return "".join((source or "").split())
    out: list[str] = []
    for i in range(len(t.kind)):
        text = t.text(i)
        if t.breaks_before(i) and (text in ("++", "--") or t.text(i - 1) in _RESTRICTED):
            out.append("")
        out.append(text)
    return "\n".join(out)


def may_parse(source: str | None) -> bool | None:
    """False where no parser accepts the text: literals without an end, brackets that do not match, binary operators without an operand, literals side by side.

    True says no more than that none of these was found. Null where the text holds markup, or
    angle brackets that look like it: that is not decided here."""
    t = scan(source)
    if t.markup:
        return None
    if not t.complete or not t.matched:
        return False
    for i in range(len(t.kind)):
        after = t.text(i + 1) if i + 1 < len(t.kind) else ""
        if t.kind[i] == "mark":
            if t.text(i) in _BINARY and (after in _BINARY or after in (")", "]", ";", ",", "")):
                return False
        elif t.kind[i] in ("number", "string") and after and t.kind[i + 1] in ("number", "string") and not t.breaks_before(i + 1):
            return False
    return True


def expression_end(t: Tokens, i: int) -> int:
    """The last token of the expression that begins with token i; brackets are passed by their partners."""
    last = i
    while i < len(t.kind):
        text = t.text(i)
        if text in (";", ",") or (t.kind[i] == "mark" and text in _CLOSES):
            break
        if i > last and t.breaks_before(i) and t.text(last) not in _GOES_ON and text not in _HELD:
            break
        last = t.partner[i] if t.partner[i] > i else i
        i = last + 1
    return last
