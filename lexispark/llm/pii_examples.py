"""Labelled example texts for the personal-data model, generated from templates and a seed."""

from __future__ import annotations

import random

NAMES = ("jane", "omar", "li.wei", "a_smith", "k-meyer", "sofia99", "r.dupont", "info")
HOSTS = ("mail", "corp", "example", "uni-bonn", "shop24", "webhost")
SUFFIXES = ("com", "org", "net", "de", "fr", "es", "co.uk", "io")
FILL = ("the", "and", "une", "der", "que", "report", "was", "thing", "pour", "nicht", "results", "seen", "on", "monday", "near", "table")
CUE = {
    "email": ("email", "e-mail:", "contact", "write to", "mail me:", "courriel :"),
    "ip": ("ip", "server", "host", "ip address", "login from", "ping"),
    "card": ("card", "visa", "paid with card", "credit card no", "carte", "debit card"),
    "phone": ("tel", "phone", "call", "mobile:", "fax", "whatsapp", "call me on"),
}
OTHER = ("order", "invoice", "version", "ref", "isbn", "serial", "ticket", "build", "id", "tracking", "sku", "total $", "section", "date", "lot")


def _luhn_tail(body: str) -> str:
    total = 0
    for i, d in enumerate(reversed(body)):
        n = int(d) * (2 if i % 2 == 0 else 1)
        total += n - 9 if n > 9 else n
    return str(-total % 10)


def _grouped(digits: str, sep: str, size: int = 4) -> str:
    return sep.join(digits[i : i + size] for i in range(0, len(digits), size))


def _true(kind: str, r: random.Random) -> str:
    d = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    if kind == "email":
        name, host, suffix = r.choice(NAMES), r.choice(HOSTS), r.choice(SUFFIXES)
        at, dot = r.choice((("@", "."), (" at ", " dot "), ("(at)", "(dot)"), (" [at] ", " [dot] "), ("[at]", "."), (" @ ", ".")))
        return name + at + host + dot + suffix.replace(".", dot)
    if kind == "ip":
        return r.choice((".", "[.]", "(.)", " . ")).join(str(r.randint(1, 255)) for _ in range(4))
    if kind == "card":
        body = r.choice("3456") + d(r.choice((13, 14, 14, 14, 15)))
        return _grouped(body + _luhn_tail(body), r.choice(("", " ", "-", ".", "  ", "/")))
    style = r.randrange(5)
    if style == 0:
        return f"+{r.randint(1, 99)} {d(3)} {d(3)} {d(4)}"
    if style == 1:
        return f"({d(3)}) {d(3)}-{d(4)}"
    if style == 2:
        return f"00{r.randint(30, 49)} {d(2)} {d(3)} {d(4)}"
    if style == 3:
        return f"0{d(1)} {d(2)} {d(2)} {d(2)} {d(2)}"
    return f"{d(3)}{(s := r.choice('-. '))}{d(3)}{s}{d(4)}"


def _false(r: random.Random) -> str:
    d = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    return r.choice(
        (
            f"{r.randint(1, 12)}.{r.randint(0, 30)}.{r.randint(256, 9999)}.{r.randint(0, 999)}",
            f"20{d(2)}-{r.randint(10, 12)}-{r.randint(10, 28)} {d(2)}.{d(2)}",
            f"978-{d(1)}-{d(4)}-{d(4)}-{d(1)}",
            d(r.randint(9, 19)),
            _grouped(d(16), r.choice(("-", " "))),
            f"{d(4)}/{d(4)}/{d(3)}",
            f"sat at table {d(1)}.{d(1)}",
            f"looked at the dot matrix.{d(2)}",
            f"meet at noon. {d(2)}",
            f"{r.choice(FILL)} @ {r.choice(FILL)}. {r.choice(FILL)}",
            f"{r.choice(FILL)} (at) {r.choice(FILL)} . {r.choice(FILL)}",
            f"{r.randint(1, 9)}.{r.randint(0, 9)}.{r.randint(0, 9)}.{r.randint(0, 9)}.{r.randint(0, 9)}",
            f"{d(3)}.{d(3)}.{d(3)},{d(2)}",
            f"{d(3)} {d(3)} {d(3)}",
        )
    )


def examples(n: int, seed: int) -> list[tuple[str, str]]:
    """(text, kind) with kind "" where the text holds no personal data."""
    r, out = random.Random(seed), []
    fill = lambda: " ".join(r.choice(FILL) for _ in range(r.randint(1, 6)))
    kinds = tuple(CUE)
    for i in range(n):
        if i % 2 == 0:
            kind = kinds[(i // 2) % 4]
            # a phone number without a country code is told from any other number by its cue alone
            value, cue = _true(kind, r), r.random() < (0.95 if kind in ("phone", "card") else 0.6)
            out.append((f"{fill()} {r.choice(CUE[kind]) + ' ' if cue else ''}{value} {fill()}", kind))
        else:
            cue = r.choice(OTHER) + " " if r.random() < 0.6 else ""
            glue = r.choice(("", "", "", "x", "ab"))
            out.append((f"{fill()} {cue}{glue}{_false(r)}{r.choice(('', '', 'f', 'c3'))} {fill()}", ""))
    return out
