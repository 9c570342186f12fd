"""Labels for the fit of the trees over mails: the structure of a mail, read line by line.

There are no labelled mails, so the trees of ``mail`` are fitted on a bounded sample of mails that this reading labels. What is
found in mails is decided by the trees, which see none of it.
"""

from __future__ import annotations

import re

from sheafline.llm.mail_lines import CLOSERS, CONTACT, HEAD_ANY, INTRO as _INTRO, INTRO_A, INTRO_B, MARK, SEPARATOR, Line, bare, header_at

NEW, QUOTE, INTRO, OLD, SIGN, NOTICE = range(6)
_NOTICE = re.compile(
    r"confidential|privileged|liabilit|virus|before printing|addressee|trading style|opinion stated|bank details never|vertraulich|confidentiel|poufn|bound by|disclaimer|unsubscribe|"
    r"(?:external|outside)[^.]{0,40}(?:sender|organisation|organization|network|company)|^sent from (?:my|a) |^get the app|^\[external|^caution\b|gesendet von mein|envoy\S+ de mon",
    re.I,
)


def intro_at(lines: list[Line], k: int) -> int:
    """Number of lines of an introduction to a quotation at k, 0 if there is none."""
    s = lines[k].text
    if _INTRO.match(s):
        return 1
    if k + 1 < len(lines) and INTRO_A.match(s) and len(s) < 120 and INTRO_B.match(lines[k + 1].text) and lines[k + 1].depth == lines[k].depth:
        return 2
    return 0


def structure(lines: list[Line], names: set[str]) -> list[int]:
    """The state of each line."""
    for x in lines:
        x.state = NEW
    n = len(lines)
    k = 0
    state = NEW
    while k < n:
        x = lines[k]
        s = x.text
        if state == OLD:
            x.state = OLD
            k += 1
            continue
        if x.depth:
            end = k
            while end < n and lines[end].depth:
                end += 1
            lone = end - k == 1 and re.match(r"[0-9]", s) and not (k and lines[k - 1].state in (INTRO, QUOTE))
            for y in lines[k:end]:
                y.state = NEW if lone else QUOTE
            state = NEW if state != SIGN or not lone else state
            k = end
            continue
        intro = intro_at(lines, k)
        if intro:
            for y in lines[k : k + intro]:
                y.state = INTRO
            k += intro
            state = NEW if k < n and lines[k].depth else OLD
            continue
        after = k + 1 < n and (header_at(lines, k + 1) or bool(MARK.match(lines[k + 1].text)) or (k + 2 < n and bool(MARK.match(s)) and header_at(lines, k + 2)))
        if MARK.match(s) or header_at(lines, k) or (SEPARATOR.match(s) and after):
            state = OLD
            continue
        if state != SIGN and _signs(lines, k, names):
            state = SIGN
        if state == SIGN:
            x.state = SIGN
        elif _NOTICE.search(s) and (k == 0 or len(s) < 400):
            x.state = NOTICE
        k += 1
    return [x.state for x in lines]


def _signs(lines: list[Line], k: int, names: set[str]) -> bool:
    s = lines[k].text
    rest = []
    for y in lines[k + 1 :]:
        if y.depth or MARK.match(y.text) or _INTRO.match(y.text) or INTRO_A.match(y.text):
            break
        rest.append(y)
    spelled = re.compile(r"\S+ ?[\[(]?\bat\b[\])]? ?\S+ ?[\[(]?\bdot\b|\S+ [\[(]at[\])] \S+", re.I)
    short = lambda y: (len(y.text.split()) <= 4 and len(y.text) < 45) or bool(spelled.search(y.text))
    if SEPARATOR.match(s):
        return not rest or short(rest[0])
    if bare(s) in CLOSERS and len(s) < 40:
        return not rest or short(rest[0]) or bool(_NOTICE.search(rest[0].text)) or header_at(lines, k + 1)
    if bare(s) in names and k > 0:
        # without a closing formula: the sender's name, and nothing but short lines, contacts and notices after it
        return all(short(y) or CONTACT.match(y.text) or _NOTICE.search(y.text) or HEAD_ANY.match(y.text) for y in rest[:3]) and not s.endswith(",")
    return False
