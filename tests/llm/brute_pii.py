"""Personal data by plain Python: another reading of what :mod:`chunkloom.llm.pii` states, for small texts."""

import hashlib

import regex

from chunkloom.llm import pii

RE = {kind: regex.compile(pattern) for kind, pattern in pii.PATTERNS.items()}
TITLES = {gender: set(words.split("|")) for gender, words in pii.TITLES.items()}


def titled(match):
    """Titles and name words of a titled name."""
    words = match.split(" ")
    n = next(i for i, w in enumerate(words) if w.rstrip(".") not in set().union(*TITLES.values()))
    return [w.rstrip(".") for w in words[:n]], words[n:], match[: sum(len(w) + 1 for w in words[:n])]


def script_of(word):
    return "cyrillic" if regex.match(r"\p{Cyrillic}", word) else "greek" if regex.match(r"\p{Greek}", word) else "latin"


def roles(text):
    out = {}
    for m in RE["name"].finditer(text):
        titles, words, _ = titled(m.group())
        gender = "f" if TITLES["f"] & set(titles) else "m" if TITLES["m"] & set(titles) else "u"
        for i, w in enumerate(words):
            role = "n" if i == len(words) - 1 else gender
            out[w] = min(out.get(w, role), role)
    return {w: f"name-{r}-{script_of(w)}:{w.lower()}" for w, r in out.items()}


def found(text, names):
    """(start, stop, kind, match) in order: at each position the first kind that matches there."""
    if names:
        alone = regex.compile(r"(?<!\p{L})(?:" + "|".join(sorted(names)) + r")(?!\p{L})")
    at = 0
    while at < len(text):
        hit = next(((k, m) for k in pii.KINDS if (m := RE[k].match(text, at))), None)
        if not hit and names and (m := alone.match(text, at)):
            hit = "name", m
        if hit:
            yield at, hit[1].end(), *hit
            at = hit[1].end()
        else:
            at += 1


def mod97(s):
    return int("".join(str(int(c, 36)) for c in s)) % 97


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def seed_of(secret, key, attempt=0):
    return sha(f"{secret}\x1e" + sha(f"{secret}\x1f{attempt}\x1f{key}"))


def number_of(seed):
    return "".join(str(int(seed[15 * i: 15 * i + 15], 16) % 10**15).zfill(15) for i in range(4))


def laid_out(text, given, replaced):
    rest = iter(given)
    return "".join(next(rest) if regex.match(replaced, c) else c for c in text) + "".join(rest)


def made(secret, key, attempt):
    kind, value = key.split(":", 1)
    seed, number = seed_of(secret, key, attempt), number_of(seed_of(secret, key, attempt))
    if kind.startswith("name"):
        _, role, script = kind.split("-")
        table = pii.SYLLABLES[script]
        body = [table[int(seed[8 * i: 8 * i + 7], 16) % len(table)] for i in range(4)]
        body += [table[int(sha(f"{seed}\x1f{i}")[:7], 16) % len(table)] for i in range(1, attempt + 1)]
        return "".join(body) + pii.ENDINGS[script][role]
    if kind == "email":
        domain = value.split("@")[-1]
        return f"u{seed[:14]}@d{seed_of(secret, 'domain:' + domain)[:10]}.example.{domain.split('.')[-1]}"
    left = "x" + seed[:12] if attempt >= pii.TRIES * (2 if kind.startswith("phone") else 1) else ""
    if kind == "ip":
        out = ".".join(str(int(seed[4 * i: 4 * i + 4], 16) % 254 + 1) for i in range(4))
    elif kind == "ipv6":
        out = laid_out(value, seed[: len(value.replace(":", ""))], "[0-9a-f]")
    elif kind == "iban":
        body = "".join(number[i - 1] if value[i - 1].isdigit() else chr(int(seed[2 * (i % 30): 2 * (i % 30) + 4], 16) % 26 + 65) for i in range(5, len(value) + 1))
        out = value[:2] + str(98 - mod97(body + value[:2] + "00")).zfill(2) + body
    elif kind == "card":
        body = value[0] + number[1: len(value) - 1]
        out = body + str(-luhn(body + "0") % 10) if luhn(value) == 0 else value[0] + number[1: len(value)]
    elif kind == "ssn":
        out = number[: len(value)]
    else:
        code = len(kind) - len("phone+") if kind.startswith("phone+") and attempt < pii.TRIES else 0
        out = value[:code] + number[code: len(value)]
    return out + left


def replaced(text, secret, attempts):
    names, out, at = roles(text), [], 0
    give = lambda key: made(secret, key, attempts.get(key, 0))
    for start, stop, kind, match in found(text, names):
        m = match.group()
        digits = "".join(c for c in m if c in "0123456789")
        if kind == "name":
            _, words, head = titled(m)
            new = head + " ".join(
                s.upper() if len(w) > 1 and w.upper() == w else s[0].upper() + s[1:] for w in words for s in [give(names[w])]
            )
        elif kind == "email":
            new = give("email:" + m.lower())
        elif kind == "iban":
            plain = m.replace(" ", "")
            new = laid_out(m, give("iban:" + plain), "[A-Z0-9]") if mod97(plain[4:] + plain[:4]) == 1 else m
        elif kind in ("ip", "ipv6"):
            new = give(f"{kind}:{m.lower()}")
        elif kind == "phone" and m.startswith("+"):
            new = laid_out(m, give(f"phone+{regex.match(pii.COUNTRY, digits).group()}:{digits}"), "[0-9]")
        else:
            new = laid_out(m, give(f"{kind}:{digits}"), "[0-9]")
        out += [text[at:start], new]
        at = stop
    return "".join(out) + text[at:]
