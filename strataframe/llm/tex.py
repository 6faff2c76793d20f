"""Words and prose of TeX sources.

Both views expand the author's own macros where they are used (in the order of the source, arguments included) and undo
discretionary hyphens. :func:`streams` keeps every word, with footnotes and comments as texts of their own, so that
remarks between words do not part them. :func:`prose` keeps running text only.
"""

from __future__ import annotations

import re

_DEFINE = re.compile(
    r"\\(?P<how>newcommand|renewcommand|providecommand|DeclareRobustCommand|def|gdef|edef|xdef|long\\def)\*?[ \t]*\{?[ \t]*\\(?P<name>[A-Za-z@]+)[ \t]*\}?[ \t]*"
    r"(?:\[(?P<n>\d)\])?(?:\[(?P<opt>[^\]\n]*)\])?(?P<marks>(?:#\d)*)[ \t]*(?=\{)"
)
_USE = re.compile(r"\\([A-Za-z@]+)(?:\{\})?")
_COMMENT = re.compile(r"(?<!\\)((?:\\\\)*)%([^\n]*)(?:\n[ \t]*)?")
_ASIDE = re.compile(r"\\(?:footnote|footnotetext|todo|thanks|marginpar)(?![A-Za-z@])(?:\[[^\]\n]*\])?[ \t]*\{")
#: Commands whose arguments are keys, names or measures rather than text.
_KEYED = (
    r"cite[a-zA-Z]*|[a-zA-Z]*ref|label|tag|index|input|include|subfile|includegraphics|bibliography|bibliographystyle|bibitem"
    r"|usepackage|RequirePackage|documentclass|vspace|hspace|pagestyle|thispagestyle|setlength|setcounter|graphicspath|url|begin|end"
)
_KEYS = re.compile(r"\\(?:" + _KEYED + r")(?![a-zA-Z])\*?(?:[ \t]*\[[^\]]*\])*(?:[ \t]*\{[^{}]*\})?")
_INPUT = re.compile(r"\\(?:input|include|subfile)[ \t]+[^\s{}\\]+")
#: Commands that only change the look of their argument.
_LOOKS = re.compile(r"\\(?:emph|text[a-z]+|bf|it|em|rm|sc|sl|tt|sf|bfseries|itshape|underline|mbox)(?![A-Za-z])[ \t]*")
_ACCENT = re.compile(r"\\[\"'`^~=.](?=[A-Za-z{])|\\[\"'`^~=.]\{")
_COMMAND = re.compile(r"\\(?:[A-Za-z@]+\*?|.)", re.S)
_WORD = re.compile(r"[^\W_]+")
_BRACE = re.compile(r"\\.|[{}]", re.S)
#: Macros within macros are expanded this deep (each level is another macro, as none is expanded inside itself).
DEEPEST = 200


def _closing(text: str, at: int) -> int | None:
    """End (exclusive) of the braced group that opens at ``at``, None if it never closes."""
    depth = 0
    for m in _BRACE.finditer(text, at):
        c = m.group()
        depth += (c == "{") - (c == "}")
        if depth == 0:
            return m.end()
    return None


def _body(text: str, at: int) -> int:
    """As :func:`_closing`, the end of the text for a group that never closes."""
    end = _closing(text, at)
    return len(text) if end is None else end


def _lifted(text: str, head: re.Pattern, instead: str) -> tuple[str, list[str]]:
    """Text with ``instead`` in the place of every command that ``head`` matches (up to its brace) and its argument, and the arguments. Groups that never close stay."""
    out, found, last = [], [], 0
    for m in head.finditer(text):
        if m.start() < last or (end := _closing(text, m.end() - 1)) is None:
            continue
        out += [text[last : m.start()], instead]
        found.append(text[m.end() : end - 1])
        last = end
    return ("".join(out) + text[last:] if found else text), found


def _expand(text: str, macros: dict[str, tuple[int, str | None, str]], depth: int = 0) -> str:
    """Replaces uses of ``macros``; a macro inside itself stays as it is."""
    out, last = [], 0
    for m in _USE.finditer(text):
        if m.start() < last or m.group(1) not in macros:
            continue
        count, default, body = macros[m.group(1)]
        end, given = m.end(), []
        if count:
            end = m.start(1) + len(m.group(1))
            if default is not None:
                opt = re.compile(r"[ \t]*\[([^\]]*)\]").match(text, end)
                given.append(opt.group(1) if opt else default)
                end = opt.end() if opt else end
            while len(given) < count:
                k = end
                while k < len(text) and text[k] in " \t":
                    k += 1
                if k >= len(text) or text[k] != "{":
                    break
                end = _body(text, k)
                given.append(text[k + 1 : end - 1])
            if len(given) < count:
                continue
            body = re.sub(r"#(\d)", lambda a, g=given: g[int(a.group(1)) - 1] if 0 < int(a.group(1)) <= len(g) else "", body)
        if depth < DEEPEST and "\\" in body:
            body = _expand(body, {k: v for k, v in macros.items() if k != m.group(1)}, depth + 1)
        out += [text[last : m.start()], body]
        last = end
    return text if not out else "".join(out) + text[last:]


def expanded(text: str) -> str:
    """The source without its definitions, macros of its own replaced by what they stand for where they are in force."""
    out, macros, last = [], {}, 0
    for m in _DEFINE.finditer(text):
        if m.start() < last:
            continue
        piece = text[last : m.start()]
        out.append(_expand(piece, macros) if macros else piece)
        last = _body(text, m.end())
        count = int(m.group("n") or 0) or m.group("marks").count("#")
        if not (m.group("how") == "providecommand" and m.group("name") in macros):
            macros[m.group("name")] = (count, m.group("opt"), text[m.end() + 1 : last - 1])
    piece = text[last:]
    out.append(_expand(piece, macros) if macros else piece)
    return "".join(out)


def _clean(text: str) -> str:
    return text.replace("\r\n", "\n").replace("\r", "\n").replace("\ufeff", "")


def _plain(text: str) -> str:
    """Text without markup. Look commands and braces vanish without parting a word."""
    text = _INPUT.sub(" ", _KEYS.sub("", text)).replace("\\-", "")
    text = _LOOKS.sub("", text)
    text = _COMMAND.sub(" ", text)
    return text.replace("{", "").replace("}", "").replace("~", " ")


def streams(text: str) -> list[list[str]]:
    """Words in lower case: of the source, then of each aside, then of what is commented out (read in the same way)."""
    found: list[list[str]] = []
    todo = [expanded(_clean(text))]
    while todo:
        source = todo.pop(0)
        if "%" in source:
            aside: list[str] = []

            def out(m: re.Match, aside: list[str] = aside) -> str:
                aside.append(m.group(2).lstrip("%"))
                return m.group(1)

            source = _COMMENT.sub(out, source)
            if aside:
                todo.append("\n".join(aside))
        source, notes = _lifted(source, _ASIDE, "")
        todo += notes
        words = _WORD.findall(_plain(source).lower())
        if words:
            found.append(words)
    return found


#: Environments that hold no running text.
_SKIP = "equation|align|alignat|gather|multline|eqnarray|displaymath|math|figure|table|tabular|array|thebibliography|comment|verbatim|lstlisting|algorithm|algorithmic|tikzpicture|filecontents"
_ENVIRONMENT = re.compile(r"\\begin[ \t]*\{(" + _SKIP + r")(\*?)\}.*?(?:\\end[ \t]*\{\1\2\}|\Z)", re.S)
_OFF = re.compile(r"\\iffalse(?![A-Za-z]).*?(?:\\(?:fi|else)(?![A-Za-z])|\Z)", re.S)
_DISPLAY = re.compile(r"\\\[.*?(?:\\\]|\Z)|(?<!\\)\$\$.*?(?:\$\$|\Z)|\\\(.*?(?:\\\)|\Z)", re.S)
_INLINE = re.compile(r"(?<!\\)\$(?:[^$\\]|\\.)*\$", re.S)
_HEADS = re.compile(r"\\(?:(?:sub)*section|chapter|part|paragraph|title|author|date|caption|affiliation|email|keywords)\*?(?![A-Za-z])(?:\[[^\]\n]*\])?[ \t]*\{")


def prose(text: str) -> str:
    """Running text: no preamble, markup, headings, formulas, floats, footnotes, bibliography or commented-out text.

    A formula becomes one blank; paragraphs end in a blank line.
    """
    source = _COMMENT.sub(r"\1", _clean(text))
    source = _OFF.sub(" ", source)
    source = expanded(source)
    start = source.find("\\begin{document}")
    source = source[start + 16 :] if start >= 0 else source
    end = source.find("\\end{document}")
    source = source[:end] if end >= 0 else source
    source = _ENVIRONMENT.sub("\n\n", source)
    source = _INLINE.sub(" ", _DISPLAY.sub(" ", source))
    source, _ = _lifted(source, _ASIDE, "")
    source, _ = _lifted(source, _HEADS, "\n\n")
    return _plain(source)
