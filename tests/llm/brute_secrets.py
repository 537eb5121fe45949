"""The base kinds by Python's re, one text at a time."""

import hashlib
import re

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")


def base(text):
    text = text or ""
    found = [(m.start(), 0, "assign", m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    found += [(m.start(), 1, "access", m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 18]
    found += [(m.start(), 2, "hex", m.end()) for m in HEX.finditer(text) if len(m[0]) >= 16]
    found.sort()
    joined = ",".join(f"{k}:{a}:{b}" for a, _, k, b in found)
    count = lambda k: sum(x[2] == k for x in found)
    return count("assign"), count("access"), count("hex"), hashlib.sha256(joined.encode()).hexdigest(), joined


#: The further kinds, in their order after the base ones.
MORE = [
    ("pem", re.compile(r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----")),
    ("bearer", re.compile(r"[Bb]earer +[A-Za-z0-9._~+/-]{20,}")),
    ("github", re.compile(r"gh[pousr]_[A-Za-z0-9]{36,}")),
    ("slack", re.compile(r"xox[abprs]-[A-Za-z0-9-]{10,}")),
    ("jwt", re.compile(r"eyJ[A-Za-z0-9_-]{10,}(?:\.[A-Za-z0-9_-]{10,}){2}")),
    ("login", re.compile(r"""[a-z][a-z0-9+]{2,15}://[^\x00-\x20:/@"']{1,64}:[^\x00-\x20:/@"']{3,64}@""")),
]


def all_spans(text):
    text = text or ""
    found = [(int(a), i, f"{k}:{a}:{b}") for i, k in enumerate(("assign", "access", "hex")) for k2, a, b in (x.split(":") for x in base(text)[4].split(",") if x) if k2 == k]
    found += [(m.start(), 3 + i, f"{kind}:{m.start()}:{m.end()}") for i, (kind, p) in enumerate(MORE) for m in p.finditer(text)]
    return ",".join(x for _, _, x in sorted(found))
