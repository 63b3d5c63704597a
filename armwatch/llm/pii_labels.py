"""The small labelled table of personal data that patterns miss.

Rows are made by a fixed rule: every form of a kind stands in every context of that kind, with
digits and words drawn from a seed, and forms that only look alike stand in the same places
unmarked. ``#`` is a digit, ``~`` a word, ``^`` a hexadecimal group, ``=`` the digit that makes
the number pass its check, ``!`` one that makes it fail.
"""

from __future__ import annotations

import random

KINDS = ("email", "ip", "card", "phone")

FORMS = {
    "email": ("~ at ~ dot com", "~ at ~ dot org", "~ (at) ~ (dot) net", "~ [at] ~ [dot] com",
              "~ @ ~ . org", "~ dot ~ at ~ dot com", "~##(at)~(dot)org", "~[at]~[dot]net",
              "~ (at) ~ (punkt) de", "~ at ~ dot ~ dot edu"),
    "ip": ("2001:db8:^::^", "fe80::^:^:^", "^:^:^:^:^:^:^:^", "10[.]##[.]1##[.]#",
           "192[.]168[.]1[.]##", "172(.)16(.)##(.)1##", "10 . 1## . ## . #"),
    "card": ("4###.####.####.###=", "5###/####/####/###=", "4###_####_####_###=",
             "3### ###### .. ####=".replace(" .. ", ".").replace(" ", ".")),
    "phone": ("(###) ###-####", "###-###-####", "###.###.####", "(0##) #### ####",
              "0### ### ####", "0##/#######", "0# ## ## ## ##", "(###)###-####"),
}
#: Forms that look like one of the kind and are none.
ALIKE = {
    "email": ("~ at ~", "the dot ~ at noon", "~ @ ##", "at the ~ dot"),
    "ip": ("1#:##", "version 1.##.#", "0#:##:##", "ratio #:##"),
    "card": ("4###.####.####.###!", "5###/####/####/###!", "################", "##.##.####"),
    "phone": ("20##-##-##", "#,###,###", "###-###", "##.##", "##########", "§ ## ##"),
}
CONTEXTS = {
    "email": ("write to {} for more", "contact {} today", "my mail is {} and",
              "send it to {} please", "escribe a {} para", "écrivez à {} pour",
              "schreiben Sie an {} oder", "you can reach me : {}", "{}", "from {} on monday"),
    "ip": ("the server {} was down", "connect to {} now", "host {} is up", "from address {} at",
           "el servidor {} es", "le serveur {} est", "der Server {} ist", "ping {} again", "{}",
           "blocked ip {} today"),
    "card": ("card number {} expires", "paid with card {} on", "my visa is {} and", "charge {} now",
             "tarjeta {} de", "carte {} du", "Karte {} von", "the number {} was", "{}",
             "use {} to pay"),
    "phone": ("call {} now", "phone {} today", "my number is {} and", "tel : {} or",
              "llame al {} hoy", "téléphone {} pour", "Telefon {} oder", "mobile {} after six",
              "{}", "text me at {} tonight"),
}
#: Syllables of drawn words.
SYLLABLES = "an el mi ro ta ver son ka li due ber no ra chi sto pe".split()


def luhn(digits: str) -> bool:
    """Whether the digits pass the check of card numbers."""
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def filled(pattern: str, draw: random.Random) -> str:
    out = "".join(
        str(draw.randrange(10)) if c == "#" else
        "".join(draw.choices(SYLLABLES, k=draw.randint(1, 3))) if c == "~" else
        f"{draw.randrange(16 ** 4):x}" if c == "^" else c for c in pattern)
    for sign in "=!":
        if sign in out:
            digits = "".join(c for c in out if c.isdigit())
            right = next(str(d) for d in range(10) if luhn(digits + str(d)))
            out = out.replace(sign, right if sign == "=" else str((int(right) + 1) % 10))
    return out


def marked_texts(seed: int = 7, contexts: slice = slice(None)) -> list[tuple[str, list]]:
    """(text, [(start, kind, end)]) rows; ``contexts`` picks among those of each kind."""
    draw, rows = random.Random(seed), []
    for kind, name in enumerate(KINDS):
        for around in CONTEXTS[name][contexts]:
            for forms, counts in ((FORMS[name], True), (ALIKE[name], False)):
                for pattern in forms:
                    plain = [filled("~", draw) for _ in range(8)]
                    before, after = around.split("{}")
                    start = " ".join([*plain[:4], before.strip()]).strip() + " "
                    shown = filled(pattern, draw)
                    text = start + shown + " " + " ".join([after.strip(), *plain[4:]]).strip()
                    rows.append((text, [(len(start), kind, len(start) + len(shown))]
                                 if counts else []))
    return rows
