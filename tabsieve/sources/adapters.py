"""Feature adapters for raw pages: address-string counters and page-content counters.

Plain column expressions (no UDF): they run inside the scan stage and read only the columns used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Counted characters and address parts of the feature vocabulary.
CHARS = {
    "dot": ".", "hyphen": "-", "underline": "_", "slash": "/", "questionmark": "?", "equal": "=", "at": "@",
    "and": "&", "exclamation": "!", "space": " ", "tilde": "~", "comma": ",", "plus": "+", "asterisk": "*",
    "hashtag": "#", "dollar": "$", "percent": "%",
}
PARTS = ("url", "domain", "directory", "file", "params")
HTML_FEATURES = [
    "LineOfCode", "LargestLineLength", "NoOfImage", "NoOfCSS", "NoOfJS", "NoOfSelfRef", "NoOfExternalRef",
    "HasTitle", "HasFavicon", "HasDescription", "HasCopyrightInfo", "HasSocialNet", "IsResponsive",
    "HasSubmitButton",
]

DOMAIN_RE = "^[a-zA-Z]+://([^/?#]*)"
PATH_RE = "^[a-zA-Z]+://[^/?#]*([^?#]*)"
PARAMS_RE = "[?]([^#]*)"
DIRECTORY_RE = "^(.*/)[^/]*$"
FILE_RE = "([^/]*)$"


def _count(text: Column, ch: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(ch), F.lit("")))


def _or_absent(present: Column, value: Column) -> Column:
    return F.when(present, value.cast("double")).otherwise(F.lit(-1.0))


def url_feature_names() -> list[str]:
    names = [f"qty_{c}_{p}" for p in PARTS for c in CHARS]
    return names + ["qty_tld_url", "length_url", "email_in_url", "qty_vowels_domain", "server_client_domain",
                    "domain_length", "domain_in_ip", "directory_length", "file_length", "params_length",
                    "qty_params", "tld_present_params"]


def url_features(df: DataFrame, url: str = "url") -> DataFrame:
    """Counters per address part; -1 where the address has no such part. The address itself is dropped."""
    u = F.col(url)
    parts = df.withColumns({
        "_url": u,
        "_domain": F.regexp_extract(u, DOMAIN_RE, 1),
        "_path": F.regexp_extract(u, PATH_RE, 1),
        "_params": F.regexp_extract(u, PARAMS_RE, 1),
        "_has_params": F.contains(u, F.lit("?")),
    }).withColumns({
        "_directory": F.regexp_extract("_path", DIRECTORY_RE, 1),
        "_file": F.regexp_extract("_path", FILE_RE, 1),
        "_has_path": F.length("_path") > 0,
        "_tld": F.regexp_extract("_domain", "([^.]*)$", 1),
    })
    present = {"url": F.lit(True), "domain": F.length("_domain") > 0, "directory": F.col("_has_path"),
               "file": F.col("_has_path"), "params": F.col("_has_params")}
    cols = {
        f"qty_{name}_{p}": _or_absent(present[p], _count(F.col(f"_{p}"), ch))
        for p in PARTS for name, ch in CHARS.items()
    }
    vowels = F.length("_domain") - F.length(F.regexp_replace("_domain", "[aeiouAEIOU]", ""))
    cols |= {
        "qty_tld_url": F.length("_tld").cast("double"),
        "length_url": F.length("_url").cast("double"),
        "email_in_url": F.contains(F.col("_url"), F.lit("@")).cast("double"),
        "qty_vowels_domain": vowels.cast("double"),
        "server_client_domain": F.regexp_like("_domain", F.lit("server|client")).cast("double"),
        "domain_length": F.length("_domain").cast("double"),
        "domain_in_ip": F.regexp_like("_domain", F.lit("^[0-9]+([.][0-9]+){3}(:[0-9]+)?$")).cast("double"),
        "directory_length": _or_absent(F.col("_has_path"), F.length("_directory")),
        "file_length": _or_absent(F.col("_has_path"), F.length("_file")),
        "params_length": _or_absent(F.col("_has_params"), F.length("_params")),
        "qty_params": _or_absent(F.col("_has_params"), _count(F.col("_params"), "&") + 1),
        "tld_present_params": _or_absent(
            F.col("_has_params"),
            F.contains(F.col("_params"), F.concat(F.lit("."), F.col("_tld"))).cast("int")),
    }
    keep = [c for c in df.columns if c != url]
    return parts.select(*keep, *[e.alias(n) for n, e in cols.items()])


def _hits(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)).cast("double")


def _has(text: Column, pattern: str) -> Column:
    return F.regexp_like(text, F.lit(pattern)).cast("double")


# What each content counter looks for (case-insensitive).
COUNT_PATTERNS = {
    "NoOfImage": "(?i)<img", "NoOfCSS": "(?i)<style|rel=.?stylesheet", "NoOfJS": "(?i)<script",
    "NoOfSelfRef": "(?i)href=.[/#]", "NoOfExternalRef": "(?i)href=.https?:",
}
FLAG_PATTERNS = {
    "HasTitle": "(?i)<title>[^<]", "HasFavicon": "(?i)rel=.?(shortcut )?icon",
    "HasDescription": "(?i)name=.?description", "HasCopyrightInfo": "(?i)copyright|&copy;",
    "HasSocialNet": "(?i)facebook|twitter|instagram|linkedin", "IsResponsive": "(?i)name=.?viewport",
    "HasSubmitButton": "(?i)type=.?submit",
}


def html_features(df: DataFrame, html: str = "html") -> DataFrame:
    """The page-content counters; the page text is dropped."""
    h = F.col(html)
    cols = {
        "LineOfCode": (_count(h, "\n") + 1).cast("double"),
        "LargestLineLength": F.array_max(F.transform(F.split(h, "\n"), F.length)).cast("double"),
    }
    cols |= {n: _hits(h, p) for n, p in COUNT_PATTERNS.items()}
    cols |= {n: _has(h, p) for n, p in FLAG_PATTERNS.items()}
    keep = [c for c in df.columns if c != html]
    return df.select(*keep, *[cols[n].alias(n) for n in HTML_FEATURES])
