"""Content and host predicates as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Patterns of instructions hidden in content, with their labels, in report order.
INJECTION: tuple[tuple[str, str], ...] = (
    (r"(?iU)ignore\s+(all\s+)?previous\s+instructions", "instruction override"),
    (r"(?iU)you\s+are\s+now\s+", "role reassignment"),
    (r"(?iU)(?:\A|\n)\s*system\s*:\s*(?:you are|you're|as an? )", "system prompt injection"),
    (r"(?i)\[INST\]|\[/INST\]|<\|im_start\|>|<\|im_end\|>", "chat template injection"),
    (r"\n\n(?:Human|Assistant):", "chat delimiter injection"),
    (r"(?iU)reveal\s+(your|the)\s+(system|secret|confidential)", "data exfiltration"),
    (r"(?iU)act\s+as\s+(if\s+you\s+are|a)\s+", "role manipulation"),
)
#: Textual forms of hosts that are not public.
PRIVATE_HOSTS = (
    r"(?i)\Alocalhost\z",
    r"\A(0|127|10)\.",
    r"\A172\.(1[6-9]|2[0-9]|3[01])\.",
    r"\A192\.168\.",
    r"\A169\.254\.",
    r"\A100\.(6[4-9]|[7-9][0-9]|1[01][0-9]|12[0-7])\.",
    r"\A(::1|::|0:0:0:0:0:0:0:0)\z",
    r"(?i)\Afe[89ab]",
    r"(?i)\Af[cd]",
)
CODE_BYTES = 1_024_000
SOURCE_BYTES = 50 * 1024 * 1024


def injection_labels(text: Column) -> Column:
    """Labels of the patterns found in a text, in order."""
    return F.array_compact(F.array(*[F.when(text.rlike(p), F.lit(label)) for p, label in INJECTION]))


def is_private_host(host: Column) -> Column:
    """Whether a host name or address is private, by its text; brackets and mapped IPv4 are unwrapped."""
    bare = F.regexp_replace(host, r"\A\[(.*)\]\z", "$1")
    bare = F.regexp_replace(bare, r"(?i)\A::ffff:([0-9]+\.[0-9]+\.[0-9]+\.[0-9]+)\z", "$1")
    found = F.lit(False)
    for p in PRIVATE_HOSTS:
        found = found | bare.rlike(p)
    return found


def url_host(url: Column) -> Column:
    """Host of a URL, null if it has none."""
    return F.try_parse_url(url, F.lit("HOST"))


def is_fetchable(url: Column) -> Column:
    """http or https, and no private host."""
    scheme = F.lower(F.try_parse_url(url, F.lit("PROTOCOL")))
    return F.coalesce(scheme.isin("http", "https") & ~is_private_host(url_host(url)), F.lit(False))


def uses_network(command: Column) -> Column:
    """Whether a shell command fetches: curl or wget, or an inline HTTP call."""
    return command.rlike(r"(?iU)(\A|\s|&&|\||;)(curl|wget)\s") | command.rlike(r"(?iU)fetch\s*\(\s*['\"](https?://|http)|requests\.(get|post|put)\s*\(|http\.(get|request)\s*\(")


def code_fits(code: Column, most: int = CODE_BYTES) -> Column:
    """Whether code is within the size limit."""
    return F.octet_length(code) <= most


def normal_path(path: Column, base: Column) -> Column:
    """An absolute path without ``.``, ``..`` and doubled slashes; relative ones start at ``base``. Links are not followed."""
    whole = F.when(path.startswith("/"), path).otherwise(F.concat(base, F.lit("/"), path))
    parts = F.filter(F.split(whole, "/"), lambda p: ~p.isin("", "."))
    up = lambda acc: F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))
    kept = F.aggregate(parts, F.array().cast("array<string>"), lambda acc, p: F.when(p == "..", up(acc)).otherwise(F.concat(acc, F.array(p))))
    return F.concat(F.lit("/"), F.array_join(kept, "/"))


def is_within(path: Column, folder: Column) -> Column:
    """Whether a path is a folder or lies in it."""
    root = normal_path(folder, F.lit("/"))
    at = normal_path(path, root)
    return (root == "/") | (at == root) | at.startswith(F.concat(root, F.lit("/")))
