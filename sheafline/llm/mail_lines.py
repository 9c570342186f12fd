"""Lines of mails with the cues that their wording gives."""

from __future__ import annotations

import re

#: Closing formulas, words of header fields by their kind, words of introductions to quotations.
CLOSERS = (
    "kind regards", "best regards", "warm regards", "regards", "kr", "br", "rgds", "many thanks", "thanks", "thank you", "with thanks", "thanks and regards", "best wishes", "best", "yours sincerely",
    "yours faithfully", "yours truly", "sincerely", "cheers", "all the best", "mfg", "mit freundlichen grüßen", "viele grüße", "cordialement", "bien cordialement", "saludos", "un saludo", "pozdrawiam",
)
_FROM = r"(?:From|Von|De|Od|Da)"
_FIELD = r"(?:From|Von|De|Od|Da|Sent|Gesendet|Envoy\S{1,8}|Enviado|Wys\S{1,6}ano|Date|Datum|Fecha|Data|To|An|À|Para|Do|Cc|Kopie|Subject|Betreff|Objet|Asunto|Temat)"
HEAD_FIRST = re.compile(rf"^\*?{_FROM} ?:\*? ?\S", re.I)
HEAD_ANY = re.compile(rf"^\*?{_FIELD} ?:\*?(?: |$)", re.I)
_WROTE = r"(?:wrote|schrieb|crit|escribi\S{1,6}|pisze|napisa\S{1,6})"
INTRO = re.compile(rf"^(?:(?:On|Am|Le|El|W dniu) .*[0-9].*{_WROTE}.{{0,80}}|.{{0,60}}\b{_WROTE} (?:on|am|le|el) .*[0-9].*) ?:$", re.I)
INTRO_A = re.compile(r"^(?:On|Am|Le|El|W dniu) .*[0-9]{1,4}.*$", re.I)
INTRO_B = re.compile(rf"^.{{0,80}}\b{_WROTE} ?:$", re.I)
MARK = re.compile(r"^(?:-{2,} ?.*\b(?:message|nachricht|messaggio|mensaje|wiadomo\S+|transf\S*|forwarded|original)\b.* ?-{2,}|begin forwarded message ?:|anfang der weitergeleiteten nachricht ?:)$", re.I)
QUOTED = re.compile(r"^\s{0,2}((?:[>|]\s?)+)(.*)$", re.S)
SEPARATOR = re.compile(r"^(?:-- ?|_{5,}|-{5,}|={5,}|\*{5,})$")
CONTACT = re.compile(r"^(?:t|tel|telephone|phone|m|mob|mobile|ddi|dd|direct|fax|e|email|e-mail|web|www|w)\b ?[:.]? ?\S|^\S+@\S+$|^(?:https?://|www\.)\S+$|^\+?[0-9 ().-]{9,}$", re.I)
#: Cues of a line: what its wording alone suggests.
TEXT, MARKER, HEAD, INTRODUCES, INTRO_BEGINS, INTRO_ENDS, CLOSES, SEPARATES, NAMES, CONTACTS = range(10)


class Line:
    __slots__ = ("no", "text", "depth", "cue", "paragraph", "state")

    def __init__(self, no: int, text: str, depth: int, paragraph: int):
        self.no, self.text, self.depth, self.paragraph, self.cue, self.state = no, text, depth, paragraph, TEXT, 0


def sender_names(header: list[str]) -> set[str]:
    """Spellings of the sender's own name."""
    for h in header:
        if h.lower().startswith("from:"):
            name = re.sub(r"<.*|\(.*", "", h[5:]).strip(" \"'")
            words = name.split()
            out = {name.lower()} | ({words[0].lower(), f"{words[0][0]}. {words[-1]}".lower()} if words and "@" not in name else set())
            return {x for x in out if x and "@" not in x}
    return set()


def bare(s: str) -> str:
    return s.strip(" ,.!*-–").lower()


def cue_of(s: str, names: set[str]) -> int:
    if MARK.match(s):
        return MARKER
    if SEPARATOR.match(s):
        return SEPARATES
    if INTRO.match(s):
        return INTRODUCES
    if HEAD_ANY.match(s):
        return HEAD
    if INTRO_B.match(s):
        return INTRO_ENDS
    if len(s) < 120 and INTRO_A.match(s):
        return INTRO_BEGINS
    short = bare(s)
    if len(s) < 40 and short in CLOSERS:
        return CLOSES
    return NAMES if short in names else CONTACTS if CONTACT.match(s) else TEXT


def header_at(lines: list[Line], k: int) -> bool:
    """A copied header block begins at k."""
    if not HEAD_FIRST.match(lines[k].text):
        return False
    return sum(bool(HEAD_ANY.match(x.text)) and x.depth == lines[k].depth for x in lines[k + 1 : k + 3]) >= min(2, len(lines) - k - 1) > 0


def read_mail(text: str) -> tuple[list[Line], set[str]]:
    """The non-blank lines of the body; the spellings of the sender's name."""
    rows = text.split("\n")
    start = next((i for i, r in enumerate(rows) if not r.strip()), len(rows))
    names = sender_names(rows[:start])
    raw = [(i, rows[i].replace("\r", "").replace("\xa0", " ")) for i in range(start + 1, len(rows))]
    bars = sum(r.lstrip().startswith("|") for _, r in raw) >= 2
    lines: list[Line] = []
    paragraph = 0
    for i, r in raw:
        if not r.strip():
            paragraph += 1
            continue
        m = QUOTED.match(r)
        depth, body = 0, r
        if m and (">" in m[1] or bars):
            depth, body = len(re.sub(r"\s", "", m[1])), m[2]
        if lines and (lines[-1].depth > 0) != (depth > 0):
            paragraph += 1
        x = Line(i, body.strip(), depth, paragraph)
        x.cue = cue_of(x.text, names)
        lines.append(x)
    return lines, names
