"""Personal data by weak supervision.

Four base patterns (email, ip, card, phone) give spans that always stay. Looser patterns propose further spans of these kinds, and of
secrets, accounts, names and streets. Labelers vote on every proposed span, base ones included: for, against, or not at all. They look at
patterns, checksums and formats, gazetteers (country codes, issuers, mail hosts, given names, titles, street words, key prefixes), words
around the span, what touches it, and its mix of characters. Per kind, expectation-maximisation estimates from the votes alone how reliable
each labeler is and how likely each span is personal. A logistic classifier over the votes and the span's own text (length, characters,
repetition, the word before and what follows) learns these estimates, and decides on the spans.

A span's votes are one small number; estimating reliabilities needs only how often each number occurs, at most KINDS x CODES counts,
whatever the size of the corpus. The classifiers are fitted on at most FIT_SPANS spans a kind, about, those that hash lowest.
"""

from __future__ import annotations

import itertools
import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, map_texts, releases

#: The base kinds, and those that only the method finds.
BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "secret", "account", "name", "street")
EMAIL, IP, CARD, PHONE, SECRET, ACCOUNT, NAME, STREET = range(len(KINDS))
LABELERS = ("pattern", "format", "gazetteer", "word_for", "word_against", "border", "mix")
CODES = 3 ** len(LABELERS)
#: Characters before a span that the context labelers read.
CONTEXT = 48
#: A proposed span is added at this probability.
ACCEPT = 0.5
#: Spans of a kind on which its classifier is fitted, about.
FIT_SPANS = 4_000
#: Buckets of the word before a span.
WORDS = 32
LENGTHS, SHARES = (8, 12, 16, 24, 40), (0.01, 0.34, 0.67)
#: Features of a span: a constant, votes, length, share of digits, kinds of characters, share of different ones, the word before, what follows.
FEATURES = 1 + 2 * len(LABELERS) + (len(LENGTHS) + 1) + (len(SHARES) + 1) + 6 + (len(SHARES) + 1) + WORDS + 5

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_domain = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+").match
# these also match what can't become a span, so that one pass over the digits is linear
_ips = re.compile(r"[0-9]++(?:(?:\.[0-9]++){3})?").finditer
_cards = re.compile(r"[0-9](?:[ -]?[0-9])*+").finditer
_phones = re.compile(r"\+[0-9][ ().0-9-]+[0-9]").finditer
_digit = re.compile("[0-9]").search

# looser patterns
_at_emails = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64} ?[\[(] ?at ?[\])] ?[A-Za-z0-9-]{1,63}(?: ?(?:\.|[\[(] ?dot ?[\])]) ?[A-Za-z0-9-]{1,63})+").finditer
_fanged_ips = re.compile(r"(?<![0-9.])[0-9]{1,3}(?:\[\.\][0-9]{1,3}){3}(?![0-9])").finditer
_dotted_cards = re.compile(r"(?<![0-9.])[0-9]{4}(?:[._/][0-9]{4}){3}(?![0-9])").finditer
_bare_phones = re.compile(r"(?<![0-9+.-])(?:\([0-9]{2,4}\) ?|[0-9]{2,4}[ .-])[0-9]{3,4}[ .-][0-9]{3,4}(?![0-9])").finditer

_keyed = re.compile(r"""(?ia)(?:token|secret|key|passwd|password|passwort|pwd|bearer|credential)s?["']?[ \t]{0,3}(?:=>|:=|=|:)?[ \t]{0,3}["']?(?<=[ \t=:>"'])([^\s"'`<>()|,;]{6,256})""").finditer
_made_keys = re.compile(r"(?<![A-Za-z0-9_-])(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{30,80}|xox[abprs]-[A-Za-z0-9-]{10,80}|sk-[A-Za-z0-9]{20,80}|eyJ[A-Za-z0-9_-]{10,400}\.[A-Za-z0-9_-]{10,400}\.[A-Za-z0-9_-]{10,400}|[0-9a-fA-F]{32,128})(?![A-Za-z0-9_-])").finditer
_ibans = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])").finditer
_accounts = re.compile(r"(?ia)(?:account|acct|konto|compte|cuenta)[^\n0-9]{0,16}([0-9](?:[ -]?[0-9]){6,17})(?![0-9])").finditer
_names = re.compile(r"(?<!\w)[A-ZÀ-Þ][a-zà-ÿ]{0,20}\.?(?: [A-ZÀ-Þ][a-zà-ÿ'-]{1,20}){1,3}").finditer
_streets = re.compile(
    r"(?<![\w.])[0-9]{1,5} (?:[A-Z][a-z]{1,20} ){1,3}(?:Street|St|Avenue|Ave|Road|Rd|Lane|Ln|Drive|Boulevard|Blvd|Way|Court|Square)(?!\w)"
    r"|(?<!\w)[A-ZÄÖÜ][a-zäöüß]{1,24}(?:straße|strasse|weg|platz|allee|gasse|ring) [0-9]{1,4}[a-z]?(?!\w)"
    r"|(?<![\w.])[0-9]{1,4},? (?:rue|avenue|boulevard|place|chemin|quai) (?:de la |de l'|des |du |de |d')?[A-ZÀ-Þ][\wà-ÿ-]{1,24}"
    r"|(?<!\w)(?:Calle|Avenida|Plaza|Paseo|Camino) (?:de la |de los |del |de )?[A-ZÀ-Þ][\wà-ÿ]{1,24},? [0-9]{1,4}(?!\w)"
).finditer

# a text without any of these has no such span
ACCOUNT_WORDS = ("account", "acct", "konto", "compte", "cuenta")
KEY_WORDS = ("token", "secret", "key", "passw", "pwd", "bearer", "credential")
_street_word = re.compile(r" St|Av|Road|Rd|Lane|Ln|Drive|B(?:oul|lv)|Way|Court|Sq|stra[ßs]|weg|platz|allee|gasse|ring |rue |avenue |boulevard |place |chemin |quai |Calle|Plaza|Paseo|Camino").search

# gazetteers and context words: fixed values
COUNTRY_CODES = ("1", "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "51", "52", "54", "55", "56", "57", "60", "61", "62", "63", "64", "65", "66", "7", "81", "82", "84", "86", "90", "91", "92", "98")
MAIL_HOSTS = ("mail", "post", "inbox", "yahoo", "outlook", "proton")
ENDINGS = ("com", "org", "net", "edu", "gov", "info", "io", "de", "fr", "es", "uk", "eu", "us", "ch", "at", "it")
ISSUERS = ("34", "37", "4", "51", "52", "53", "54", "55", "6011", "65", "35", "22", "23", "24", "25", "26", "27")
KEY_PREFIXES = ("AKIA", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "xox", "sk-", "eyJ")
PLACEHOLDERS = ("changeme", "example", "password", "xxxx", "your", "null", "none", "true", "false", "todo", "test", "****", "${", "{{")
IBAN_LENGTHS = {"AT": 20, "BE": 16, "CH": 21, "CZ": 24, "DE": 22, "DK": 18, "ES": 24, "FI": 18, "FR": 27, "GB": 22, "GR": 27, "IE": 22, "IT": 27, "LU": 20, "NL": 18, "NO": 15, "PL": 28, "PT": 25, "SE": 24}
TITLES = ("Mr", "Mrs", "Ms", "Miss", "Dr", "Prof", "Sir", "Herr", "Frau", "Monsieur", "Madame", "Mme", "Mlle", "Sr", "Sra", "Don", "Doña", "Señor", "Señora")
GIVEN_NAMES = frozenset(
    "Aaron Adam Adrian Alan Albert Alejandro Alex Alexander Alice Alicia Amanda Amy Ana Andrea Andreas Andrew Angela Anna Anne Anthony Antoine Antonio Arthur Barbara Benjamin Bernd Brian Bruno Camille Carla Carlos Carmen Caroline Catherine "
    "Charles Charlotte Chloé Christian Christine Claire Clara Claude Daniel David Deborah Denis Diego Dirk Donna Edward Elena Elizabeth Emily Emma Eric Erik Fernando Francisco François Frank Gabriel George Gérard Greta Hannah Hans Heike Helen "
    "Henri Henry Hugo Inés Ingrid Isabel Jack Jacques James Jane Javier Jean Jennifer Jessica Joan Johann John Jonas Jorge José Juan Julia Julie Jürgen Karen Karin Karl Katharina Kevin Klaus Laura Lena Léa Linda Louis Lucas Lucía Luis Manuel Marc "
    "María Maria Marie Mark Markus Marta Martin Mary Matthew Michael Michel Miguel Monika Nadine Nancy Nathalie Nicolas Nicole Olivia Otto Pablo Patricia Patrick Paul Pedro Peter Petra Philippe Pierre Rachel Rafael Raquel Rebecca Renate Richard Robert "
    "Rosa Ruth Sabine Samuel Sandra Sara Sarah Sebastian Simon Sofía Sophie Stefan Stephen Susan Susanne Sylvie Thomas Ursula Uwe Valérie Werner William Wolfgang Yves".split()
)
WORDS_FOR = {
    "email": re.compile(r"(?i)\b(?:e-?mail|mail|contact|write|kontakt|courriel|correo)\b").search,
    "ip": re.compile(r"(?i)\b(?:ip|host|server|address|login|adresse|servidor)\b").search,
    "card": re.compile(r"(?i)\b(?:card|visa|credit|payment|karte|carte|tarjeta)\b").search,
    "phone": re.compile(r"(?i)\b(?:phone|tel|call|fax|mobile|telefon|téléphone|teléfono)\b").search,
    "secret": re.compile(r"(?i)(?:token|secret|api.?key|access.?key|private.?key|passw|pwd|bearer|credential|auth)").search,
    "account": re.compile(r"(?i)\b(?:iban|account|acct|bank|bic|konto|compte|cuenta|transfer)\b").search,
    "name": re.compile(r"(?i)\b(?:name is|named|i am|signed|regards|dear|sincerely|patient|author|contact|heiße|liebe[r]?|cher|chère|appelle|llamo|estimad[oa]|from|by)\b[ ,:]*$").search,
    "street": re.compile(r"(?i)\b(?:address|live[sd]?|living|visit|ship|deliver|home|located|wohn\w*|adresse|habite|domicilio|vive|dirección)\b").search,
}
WORDS_AGAINST = {
    "secret": re.compile(r"(?i)\b(?:commit|sha-?\d*|md5|checksum|digest|etag|revision|public|fingerprint|example)\b").search,
    "name": re.compile(r"(?i)\b(?:the|street|river|mount|lake|saint|battle|treaty|hotel|university|company)\b[ ]*$").search,
    "street": re.compile(r"(?i)\b(?:page|chapter|section|route|version|score)\b").search,
}
ANY_AGAINST = re.compile(r"(?i)\b(?:version|release|isbn|issn|order|sku|section|page|token|key|hash|serial|build|tracking|invoice|part)\b").search
_word_before = re.compile(r"(\w+)\W*$").search


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        total += n if i % 2 == 0 else 2 * n - 9 * (n > 4)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Around each @: the local part reaches back as far as it can, to the last match at most."""
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in LOCAL:
            start -= 1
        found = _domain(text, at + 1) if start < at else None
        if found:
            last = found.end()
            yield start, last
        at = text.find("@", max(at + 1, last))


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 3 or len(part) == 3 and int(part) <= 255


def base_spans(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(start, kind, end) of the base patterns' matches that pass their checks, sorted; and of those that don't but come close."""
    out, failed = [(a, 0, b) for a, b in _emails(text)], []
    if _digit(text):
        for m in _ips(text):
            parts = m.group().split(".")
            if len(parts) == 4:
                (out if all(map(_small, parts)) else failed).append((m.start(), 1, m.end()))
        for m in _cards(text):
            if m.end() - m.start() >= 13 and 13 <= len(d := _digits(m.group())) <= 19:
                (out if len(d) >= 14 and luhn(d) else failed).append((m.start(), 2, m.end()))
        if "+" in text:
            for m in _phones(text):
                if 7 <= (n := len(_digits(m.group()))) <= 18:
                    (out if 10 <= n <= 15 else failed).append((m.start(), 3, m.end()))
    return sorted(out), failed


def loose_spans(text: str) -> list[tuple[int, int, int, int]]:
    """(start, kind, end, pattern) of the looser patterns' matches; pattern: 1 where the form says it all but certainly, else 0."""
    out, low = [], text.lower()
    if "(at" in text or "[at" in text or "( at" in text or "[ at" in text:
        out += [(m.start(), EMAIL, m.end(), 0) for m in _at_emails(text)]
    if _digit(text):
        if "[.]" in text:
            out += [(m.start(), IP, m.end(), 0) for m in _fanged_ips(text)]
        out += [(m.start(), CARD, m.end(), 0) for m in _dotted_cards(text)]
        out += [(m.start(), PHONE, m.end(), 0) for m in _bare_phones(text)]
        out += [(m.start(), ACCOUNT, m.end(), 1) for m in _ibans(text)]
        if any(w in low for w in ACCOUNT_WORDS):
            out += [(m.start(1), ACCOUNT, m.end(1), 0) for m in _accounts(text)]
        out += [(m.start(), SECRET, m.end(), 0 if m.group().startswith(KEY_PREFIXES) else -1) for m in _made_keys(text)]  # bare hex may be a digest
        if _street_word(text):
            out += [(m.start(), STREET, m.end(), 0) for m in _streets(text)]
    for m in _keyed(text) if any(w in low for w in KEY_WORDS) else ():
        value, sure = m.group(1).rstrip(".!?:*#$%&"), text[m.start() : m.start(1)].rstrip(" \t\"'")[-1:] in ("=", ":", ">")
        if sure or len(value) >= 12 and _digit(value):  # else the words may be anything
            out.append((m.start(1), SECRET, m.start(1) + len(value), int(sure)))
    for m in _names(text):
        words = m.group().split(" ")
        if words[0].rstrip(".") in TITLES:
            out.append((m.start() + len(words[0]) + 1, NAME, m.end(), 1))
        elif not words[0].endswith(".") and (any(w in GIVEN_NAMES for w in words) or WORDS_FOR["name"](text[max(0, m.start() - CONTEXT) : m.start()])):
            out.append((m.start(), NAME, m.end(), 0))
    return [x for x in out if x[0] < x[2]]


def entropy(text: str) -> float:
    """Bits a character."""
    n = len(text)
    return -sum(c / n * math.log2(c / n) for c in Counter(text).values()) if n else 0.0


def iban(text: str) -> bool:
    plain = text.replace(" ", "")
    turned = "".join(str(int(c, 36)) for c in plain[4:] + plain[:4]) if plain.isascii() and plain.isalnum() else ""
    return bool(turned) and int(turned) % 97 == 1 and len(plain) == IBAN_LENGTHS.get(plain[:2], len(plain))


def votes(text: str, start: int, kind: int, end: int, pattern: int) -> list[int]:
    """What each of LABELERS says: 1 for, -1 against, 0 nothing. ``pattern``: the form is that of the base or a sure pattern (1), comes close to
    it (-1), or is a looser one (0)."""
    span, name = text[start:end], KINDS[kind]
    digits = _digits(span)
    before = text[max(0, start - CONTEXT) : start]
    known = mix = 0
    if kind == EMAIL:
        ending = re.split(r"[.\])] ?", span)[-1].lower()
        form, known = (1 if 2 <= len(ending) <= 6 and ending.isalpha() else -1), (1 if ending in ENDINGS or any(h in span.lower() for h in MAIL_HOSTS) else 0)
    elif kind == IP:
        parts = re.split(r"\[?\.\]?", span)
        form = 1 if len(parts) == 4 and all(map(_small, parts)) and not any(len(p) > 1 and p[0] == "0" for p in parts) else -1
        known = -1 if parts[0] in ("0", "127") or all(len(p) == 1 for p in parts) else 0
        mix = 1 if len(digits) >= 8 else 0
    elif kind == CARD:
        form, known = (1 if 14 <= len(digits) <= 19 and luhn(digits) else -1), (1 if digits.startswith(ISSUERS) else 0)
        mix = -1 if len(set(digits)) < 4 else 0
    elif kind == PHONE:
        form = 1 if (9 if pattern == 0 else 10) <= len(digits) <= 15 else -1
        known = (1 if digits.startswith(COUNTRY_CODES) else -1) if span[0] == "+" else 0
        mix = -1 if len(set(digits)) < 3 else 0
    elif kind == SECRET:
        letters = sum(c.isalpha() for c in span)
        form = 0 if pattern < 0 else 1 if len(span) >= 16 and digits and letters else -1 if len(span) < 10 or not digits else 0
        known = 1 if span.startswith(KEY_PREFIXES) else -1 if any(p in span.lower() for p in PLACEHOLDERS) else 0
        pattern = min(pattern, 0) if known < 0 else pattern
        mix = 1 if entropy(span) >= 3 else -1 if entropy(span) < 2.9 else 0
    elif kind == ACCOUNT:
        form = (1 if iban(span) else -1) if pattern == 1 else 1 if 8 <= len(digits) <= 12 else 0
        known = 1 if span[:2] in IBAN_LENGTHS else 0
        mix = -1 if len(set(digits)) < 3 else 0
    elif kind == NAME:
        words = span.split(" ")
        form = 1 if 2 <= len(words) <= 3 else 0
        known = 1 if words[0] in GIVEN_NAMES else 0 if any(w in GIVEN_NAMES for w in words) else -1
        mix = 1 if all(3 <= len(w) for w in words) else 0
    else:
        form = 1 if 1 <= len(digits) <= 4 else -1
        known = 1  # the pattern is made of street words
        mix = 1 if len(span) >= 10 else 0
    after = text[end : end + 1]
    touched = (before[-1:].isalnum() or before[-1:] in ("_", "#", "/") or kind != SECRET and before[-1:] == "=") or (after.isalnum() or after in ("_", "="))
    against = WORDS_AGAINST.get(name, ANY_AGAINST)(before)
    return [pattern, form, known, 1 if WORDS_FOR[name](before) else 0, -1 if against else 0, -1 if touched else 1, mix]


def code_of(said: list[int]) -> int:
    code = 0
    for v in said:
        code = code * 3 + v + 1
    return code


def features(text: str, start: int, end: int, said: list[int]) -> list[int]:
    """Which of FEATURES hold for a span."""
    span = text[start:end]
    n = len(span)
    out, at = [0], 1
    for v in said:
        out += [at] * (v == 1) + [at + 1] * (v == -1)
        at += 2
    out.append(at + sum(n >= k for k in LENGTHS))
    at += len(LENGTHS) + 1
    out.append(at + sum(sum(c.isdigit() for c in span) / n >= k for k in SHARES))
    at += len(SHARES) + 1
    for holds in (any(c.isupper() for c in span), any(c.islower() for c in span), " " in span, "-" in span, "." in span, not span.isascii()):
        out += [at] * holds
        at += 1
    out.append(at + sum(len(set(span)) / n >= k for k in SHARES))
    at += len(SHARES) + 1
    word = _word_before(text[max(0, start - CONTEXT) : start])
    out.append(at + zlib.crc32(word.group(1).lower().encode()) % WORDS if word else at)
    at += WORDS
    after = text[end : end + 1]
    out.append(at + (0 if not after else 1 if after.isspace() else 2 if after.isalpha() else 3 if after.isdigit() else 4))
    return out


def votes_of(codes: np.ndarray) -> np.ndarray:
    """Votes, one row a code."""
    rest, out = codes, np.zeros((len(codes), len(LABELERS)), np.int64)
    for i in range(len(LABELERS) - 1, -1, -1):
        out[:, i] = rest % 3 - 1
        rest = rest // 3
    return out


#: What is known of a labeler before any vote: a few votes, mostly right. By class and vote (-1, 0, 1).
BELIEF = np.array([[3.0, 2.0, 1.0], [1.0, 2.0, 3.0]])


def reliabilities(said: np.ndarray, counts: np.ndarray, rounds: int = 50) -> tuple[np.ndarray, np.ndarray]:
    """Expectation-maximisation over votes that depend on each other only through the span's class.

    Returns each row's probability to be personal, and per class, labeler and vote (-1, 0, 1) its probability. It starts from the
    votes' majority.
    """
    p = 1 / (1 + np.exp(-said.sum(1).astype(float)))
    table = np.full((2, said.shape[1], 3), 1 / 3)
    onehot = np.stack([said == v for v in (-1, 0, 1)], axis=2).astype(float)
    for _ in range(rounds):
        for k, w in ((0, (1 - p) * counts), (1, p * counts)):
            table[k] = (np.einsum("r,rlv->lv", w, onehot) + BELIEF[k]) / (w.sum() + BELIEF[k].sum())
        prior = ((p * counts).sum() + 1) / (counts.sum() + 2)
        logs = np.einsum("rlv,klv->kr", onehot, np.log(table))
        p = 1 / (1 + np.exp(np.clip(logs[0] - logs[1] + np.log((1 - prior) / prior), -500, 500)))
    return p, table


def span_classifier(x: np.ndarray, target: np.ndarray, rounds: int = 25, ridge: float = 1.0) -> np.ndarray:
    """Weights of a logistic regression on features (0 and 1) against the estimated probabilities, by Newton steps."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        w = w + np.linalg.solve(hessian, x.T @ (target - p) - ridge * w)
    return w


def estimates(counts: dict[tuple[int, int], int]) -> dict[tuple[int, int], float]:
    """From how often each (kind, code) occurs, how likely its spans are personal."""
    out = {}
    for kind in range(len(KINDS)):
        mine = sorted((c, n) for (k, c), n in counts.items() if k == kind)
        if mine:
            codes, n = np.array([c for c, _ in mine]), np.array([float(n) for _, n in mine])
            out |= {(kind, c): x for c, x in zip(codes.tolist(), reliabilities(votes_of(codes), n)[0].tolist(), strict=True)}
    return out


def weights(sample: list[tuple[int, int, list[int]]], likely: dict[tuple[int, int], float]) -> np.ndarray:
    """Per kind the classifier's weights, from a sample of (kind, code, features)."""
    out = np.zeros((len(KINDS), FEATURES))
    for kind in range(len(KINDS)):
        mine = sorted((c, f) for k, c, f in sample if k == kind)
        if mine:
            x = np.zeros((len(mine), FEATURES))
            for i, (_, f) in enumerate(mine):
                x[i, f] = 1
            out[kind] = span_classifier(x, np.array([likely[kind, c] for c, _ in mine]))
    return out


def spans_of(text: str) -> tuple[list[tuple], list[tuple]]:
    """Base spans, and further proposed ones that overlap none of them and lie in no longer one, of a kind the leftmost first: (start, kind,
    end, pattern)."""
    mine, failed = base_spans(text)
    near = {(*x, -1) for x in failed} | set(loose_spans(text))
    others, ends, reach = [], dict.fromkeys(range(len(KINDS)), 0), (0, 0)
    at = 0
    for a, k, b, pattern in sorted(near, key=lambda x: (x[0], -x[2], x[1], -x[3])):
        while at < len(mine) and mine[at][2] <= a:
            at += 1
        inside = b <= reach[1] and (a, b) != reach
        if b > reach[1]:
            reach = (a, b)
        if a >= ends[k] and not inside and not any(a < y for x, _, y in itertools.takewhile(lambda m: m[0] < b, mine[at:])):
            others.append((a, k, b, pattern))
            ends[k] = b
    return [(*x, 1) for x in mine], others


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, base spans, and further proposed spans, with the votes' code and the features of both."""

    def work(cols: dict) -> dict:
        base, more = [], []
        for raw in cols["text"]:
            text = raw.decode()
            for spans, to in zip(spans_of(text), (base, more), strict=True):
                found = []
                for a, k, b, pattern in spans:
                    said = votes(text, a, k, b, pattern)
                    found.append({"start": a, "kind": k, "end": b, "code": code_of(said), "features": features(text, a, b, said)})
                to.append(found)
        return {"doc_id": cols["doc_id"], "base": base, "more": more}

    span = "array<struct<start:int,kind:int,end:int,code:int,features:array<int>>>"
    return cut(map_texts(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), work, f"doc_id long, base {span}, more {span}"))


def fit(each: DataFrame, fit_spans: int = FIT_SPANS) -> np.ndarray:
    """Per kind the weights of its classifier."""
    spans = each.select("doc_id", F.explode(F.concat("base", "more")).alias("s")).select("doc_id", "s.*")
    counted = spans.groupBy("kind", "code").count().collect()  # at most KINDS x CODES rows
    counts = {(r.kind, r.code): r["count"] for r in counted}
    sizes = [sum(n for (k, _), n in counts.items() if k == kind) for kind in range(len(KINDS))]
    share = F.element_at(F.array(*(F.lit(min(1.0, fit_spans / max(1, n))) for n in sizes)), F.col("kind") + 1)
    drawn = spans.where(F.pmod(F.xxhash64("doc_id", "start", "kind"), F.lit(1 << 30)) < share * (1 << 30)).select("kind", "code", "features")
    return weights([(r.kind, r.code, list(r.features)) for r in drawn.collect()], estimates(counts))


def _written(spans: str) -> Column:
    """kind:start:end by start, then kind as listed, comma-joined."""
    names = ", ".join(f"'{k}'" for k in KINDS)
    return F.expr(f"array_join(transform(array_sort(transform({spans}, s -> struct(s.start, s.kind, s.end))), s -> concat(element_at(array({names}), s.kind + 1), ':', s.start, ':', s.end)), ',')")


def _of_kind(kind: int):
    return lambda s: s["kind"] == kind


@releases
def find_personal_data(docs: DataFrame) -> DataFrame:
    """Personal data of every row of ``docs`` (doc_id, text).

    Returns one row per row: ``doc_id``, ``n_email``, ``n_ip``, ``n_card``, ``n_phone`` (base spans of each kind), ``base`` and
    ``spans``: the base spans and all spans, written kind:start:end in code points, end exclusive, and ``n_spans``: how many these are.

    Null and empty texts have no spans; bytes that are no UTF-8 are read as replacement characters. Rows that share an id or a text are judged
    each for itself, equal texts alike. Empty tables give empty results. Extra columns are left out.
    """
    each = scan(docs)
    table = F.array(*(F.lit(float(x)) for x in fit(each).ravel()))
    logit = lambda s: F.aggregate(F.transform(s["features"], lambda f: F.get(table, s["kind"] * FEATURES + f)), F.lit(0.0), lambda a, x: a + x)
    added = F.filter("more", lambda s: logit(s) >= math.log(ACCEPT / (1 - ACCEPT)))
    return each.select(
        "doc_id",
        *(F.size(F.filter("base", _of_kind(i))).cast("long").alias(f"n_{k}") for i, k in enumerate(BASE_KINDS)),
        _written("base").alias("base"),
        F.concat("base", added).alias("all"),
    ).select("*", _written("all").alias("spans"), F.size("all").cast("long").alias("n_spans")).drop("all")
