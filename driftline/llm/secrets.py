"""Secret scans: keyword automaton, anchored expressions near hits, embedded checksums."""

from __future__ import annotations

import base64
import hashlib
import json
import re
import zlib

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftline.llm.common import arrow_columns, strings, struct

ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
#: Kinds with an embedded check, by keyword (lower case): kind, anchored expression.
GITHUB = re.compile(r"gh[pousr]_[0-9A-Za-z]{36}(?![0-9A-Za-z])")
NPM = re.compile(r"npm_[0-9A-Za-z]{36}(?![0-9A-Za-z])")
JWT = re.compile(r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+")
JWT_RUN = re.compile(r"[A-Za-z0-9_-]+")
PEM = re.compile(r"-----BEGIN ((?:[A-Z]+ )*PRIVATE KEY)-----([A-Za-z0-9+/=\s\\]*)-----END \1-----")
XPRV = re.compile(r"xprv[1-9A-HJ-NP-Za-km-z]{107}(?![0-9A-Za-z])")
AGE = re.compile(r"AGE-SECRET-KEY-1[02-9AC-HJ-NP-Z]{58}(?![0-9A-Za-z])")
NSEC = re.compile(r"nsec1[02-9ac-hj-np-z]{58}(?![0-9A-Za-z])")
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
BASE58 = "123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"
BECH32 = "qpzry9x8gf2tvdw0s3jn54khce6mua7l"
KINDS = ("assign", "access", "hex")
KEYWORDS = {
    **dict.fromkeys(("password", "passwd", "secret", "token", "apikey", "api_key"), "assign"),
    "akia": "access",
    **dict.fromkeys(("ghp_", "gho_", "ghu_", "ghs_", "ghr_"), "github"),
    "npm_": "npm",
    "eyj": "jwt",
    "-----begin ": "pem",
    "xprv": "xprv",
    "age-secret-key-1": "age",
    "nsec1": "nsec",
}
ANCHORED = {"assign": ASSIGN, "access": ACCESS, "github": GITHUB, "npm": NPM, "jwt": JWT, "pem": PEM, "xprv": XPRV, "age": AGE, "nsec": NSEC}
ORDER = {k: i for i, k in enumerate((*KINDS, "github", "jwt", "npm", "pem", "xprv", "age", "nsec"))}
#: Hex digits become "1", all else "0".
HEX_TABLE = bytes(49 if chr(b) in "0123456789abcdef" else 48 for b in range(256))
HEX_RUN = re.compile(r"[0-9a-f]{32,}")


def base62_crc(body: str) -> str:
    """CRC-32 of body as six base-62 digits."""
    n, out = zlib.crc32(body.encode()), ""
    for _ in range(6):
        n, d = divmod(n, 62)
        out = BASE62[d] + out
    return out


def base58_sound(key: str) -> bool:
    """Whether the last four bytes are the double SHA-256 of those before."""
    n = 0
    for c in key:
        n = n * 58 + BASE58.index(c)
    raw = n.to_bytes(82, "big") if n < 1 << 656 else b""
    return hashlib.sha256(hashlib.sha256(raw[:-4]).digest()).digest()[:4] == raw[-4:]


def bech32_sound(key: str) -> bool:
    """Whether the checksum of a Bech32 text (prefix, 1, data) is right."""
    prefix, _, data = key.lower().rpartition("1")
    codes = [ord(c) >> 5 for c in prefix] + [0] + [ord(c) & 31 for c in prefix] + [BECH32.index(c) for c in data]
    rest = 1
    for v in codes:
        top, rest = rest >> 25, (rest & 0x1FFFFFF) << 5 ^ v
        for i, g in enumerate((0x3B6A57B2, 0x26508E6D, 0x1EA119FA, 0x3D4233DD, 0x2A1462B3)):
            rest ^= g if top >> i & 1 else 0
    return rest == 1


def _json_of(part: str) -> object:
    try:
        return json.loads(base64.urlsafe_b64decode(part + "=" * (-len(part) % 4)))
    except (ValueError, TypeError, RecursionError):
        return None


#: Bytes of a signature, least and most, by the first two letters of the algorithm and its size.
SIGNATURES = {"HS256": (32, 32), "HS384": (48, 48), "HS512": (64, 64), "ES256": (64, 64), "ES384": (96, 96), "ES512": (132, 132)}


def jwt_sound(token: str) -> bool:
    """Header and claims are JSON objects, the header names an algorithm, and the signature has its length."""
    head, claims, signature = token.split(".")
    named, said = _json_of(head), _json_of(claims)
    if not (isinstance(named, dict) and isinstance(said, dict) and isinstance(named.get("alg"), str)):
        return False
    least, most = SIGNATURES.get(named["alg"], (16, 1 << 16))
    return len(signature) % 4 != 1 and least <= len(signature) * 3 // 4 <= most


def der_sound(body: str) -> bool:
    """The armoured bytes are one DER sequence whose length says where it ends, or OpenSSH's own format."""
    try:
        raw = base64.b64decode("".join(body.replace("\\n", "").replace("\\r", "").split()), validate=True)
    except ValueError:
        return False
    if raw.startswith(b"openssh-key-v1\0"):
        return True
    if len(raw) < 4 or raw[0] != 0x30:
        return False
    wide = raw[1] & 127 if raw[1] & 128 else 0
    return len(raw) == 2 + wide + (int.from_bytes(raw[2 : 2 + wide], "big") if wide else raw[1])


def _passes(kind: str, m: re.Match) -> bool:
    if kind == "assign":
        return len(m[2]) >= 8
    if kind == "access":
        return len(m[0]) >= 16
    if kind in ("github", "npm"):
        return base62_crc(m[0][4:-6]) == m[0][-6:]
    if kind == "jwt":
        return jwt_sound(m[0])
    if kind == "pem":
        return der_sound(m[2])
    return base58_sound(m[0]) if kind == "xprv" else bech32_sound(m[0])


class Scanner:
    """Finds (start, order of kind, end) in a text, in code points, end exclusive."""

    def __init__(self):
        self.words = ahocorasick.Automaton()
        for w, kind in KEYWORDS.items():
            self.words.add_word(w, (kind, len(w)))
        self.words.make_automaton()

    def spans(self, text: str) -> list[tuple[str, int, int]]:
        low = text.lower()
        if len(low) != len(text):  # some character's lower case is longer
            low = "".join([c.lower() if c.isascii() else c for c in text])
        starts: dict[str, list[int]] = {}
        for end, (kind, size) in self.words.iter(low):
            starts.setdefault(kind, []).append(end + 1 - size)
        out = []
        for kind, at in starts.items():
            past, match = 0, ANCHORED[kind].match
            for i in sorted(at):  # leftmost first, none overlapping
                if i < past:
                    continue
                if m := match(text, i):
                    past = m.end()
                    if _passes(kind, m):
                        out.append((i, ORDER[kind], past, kind))
                elif kind == "jwt":  # any later start in this run of letters would fail at its end, too
                    past = JWT_RUN.match(text, i).end()
        if b"1" * 32 in text.encode().translate(HEX_TABLE):
            out += [(m.start(), ORDER["hex"], m.end(), "hex") for m in HEX_RUN.finditer(text)]
        return [(kind, s, e) for s, _, e, kind in sorted(out)]


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join([f"{k}:{s}:{e}" for k, s, e in spans])


def redacted(text: str, spans: list[tuple[str, int, int]]) -> str:
    """Each run of overlapping spans becomes one mark that names its first kind."""
    out, past = [], 0
    for kind, s, e in spans:
        if s >= past:
            out += [text[past:s], f"[{kind} removed]"]
        past = max(past, e)
    return "".join([*out, text[past:]])


def find_secrets(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of docs: doc_id, n_assign, n_access, n_hex, base_sha256, spans.

    spans has every finding as kind:start:end, comma-joined, ordered by start and then
    kind; base_sha256 covers those of the kinds assign, access and hex. The further
    kinds come only with their check passed: github, npm: CRC-32 in the token; xprv:
    double SHA-256; age, nsec: Bech32 checksum; jwt: JSON header and claims, length of
    the signature; pem: matching armour around DER of the length it states. Null and
    empty texts have none. Repeated rows give repeated results. Work is linear in a
    text, whatever repeats in it.
    """
    named = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))

    def make():
        scan = Scanner().spans

        def work(texts):
            found = [scan(t) for t in strings(texts)]
            base = [[x for x in f if x[0] in KINDS] for f in found]
            counts = [pa.array([sum(x[0] == k for x in b) for b in base], pa.int64()) for k in KINDS]
            sha = [hashlib.sha256(joined(b).encode()).hexdigest() for b in base]
            return [*counts, pa.array(sha, pa.string()), pa.array([joined(f) for f in found], pa.string())]

        return work

    out = struct(
        ("n_assign", T.LongType()), ("n_access", T.LongType()), ("n_hex", T.LongType()), ("base_sha256", T.StringType()), ("spans", T.StringType())
    )
    return arrow_columns(named, ["text"], out, make, ["doc_id"])


def redact_secrets(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with every finding replaced by a mark such as [access removed]; n_chars follows.

    All rows stay. Null texts stay null.
    """
    cols = docs.columns

    def make():
        scan = Scanner().spans

        def work(texts):
            old = texts.to_pylist()
            found = [scan(t) if t else [] for t in old]
            new = [redacted(t, f) if f else t for t, f in zip(old, found, strict=True)]
            return [pa.array(new, pa.string()), pa.array([bool(f) for f in found])]

        return work

    done = arrow_columns(docs, [text], struct((text, T.StringType()), ("__changed", T.BooleanType())), make)
    out = {c: F.col(c) for c in cols}
    if "n_chars" in out:
        out["n_chars"] = F.when(F.col("__changed"), F.length(text).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")).alias("n_chars")
    return done.select(*out.values())
