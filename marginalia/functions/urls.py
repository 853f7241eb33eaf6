"""URL expressions: removing tracking parameters, network location."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Query keys that only serve tracking, and the prefix of such keys.
TRACKING_PREFIX = "utm_"
TRACKING_KEYS = (
    "fbclid", "gclid", "gclsrc", "dclid", "msclkid", "igshid", "mc_cid",
    "mc_eid", "_hsenc", "_hsmi", "mkt_tok", "vero_id", "vero_conv",
    "oly_anon_id", "oly_enc_id", "ref", "ref_src", "ref_url", "spm",
)

_SCHEME = r"^[A-Za-z][A-Za-z0-9+.\-]*:"
_NETLOC = r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)"
_GOOD_BRACKETS = r"^[^\[\]]*\[(?:[0-9A-Fa-f:.]+(?:%[^\[\]]*)?|[vV][0-9A-Fa-f]+\.[^\[\]]+)\][^\[\]]*$"


def _decode(part: Column) -> Column:
    # A percent sign that starts no escape stands for itself.
    return F.url_decode(F.regexp_replace(part, "%(?![0-9A-Fa-f]{2})", "%25"))


def _encode(part: Column) -> Column:
    return F.replace(F.replace(F.url_encode(part), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def _is_tracking(key: Column) -> Column:
    low = F.lower(key)
    return F.startswith(low, F.lit(TRACKING_PREFIX)) | low.isin(*TRACKING_KEYS)


def _pair(piece: Column) -> Column:
    raw_key = F.substring_index(piece, "=", 1)
    raw_value = F.substr(piece, F.length(raw_key) + 2)
    return F.struct(_decode(raw_key).alias("k"), _decode(raw_value).alias("v"))


def network_location(url: Column) -> Column:
    """Host part as written (user info, port and case kept); '' when there is none."""
    text = F.coalesce(url, F.lit(""))
    netloc = F.regexp_extract(text, _NETLOC, 1)
    return F.when(_bad_brackets(netloc), F.lit("")).otherwise(netloc)


def _bad_brackets(netloc: Column) -> Column:
    has = F.contains(netloc, F.lit("[")) | F.contains(netloc, F.lit("]"))
    return has & ~F.rlike(netloc, F.lit(_GOOD_BRACKETS))


def clean_url(url: Column) -> Column:
    """Drop tracking pairs from the query; a URL without a query is returned as is."""
    tidy = F.ltrim(F.translate(url, "\t\r\n", ""), F.lit("".join(map(chr, range(0x21)))))
    before_fragment = F.substring_index(tidy, "#", 1)
    fragment = F.substr(tidy, F.length(before_fragment) + 2)
    head = F.substring_index(before_fragment, "?", 1)
    query = F.substr(before_fragment, F.length(head) + 2)
    scheme = F.regexp_extract(head, _SCHEME, 0)
    new_head = F.concat(F.lower(scheme), F.substr(head, F.length(scheme) + 1))
    pairs = F.transform(F.filter(F.split(query, "&"), lambda p: p != ""), _pair)
    kept = F.array_join(
        F.transform(
            F.filter(pairs, lambda p: ~_is_tracking(p["k"])),
            lambda p: F.concat(_encode(p["k"]), F.lit("="), _encode(p["v"])),
        ),
        "&",
    )
    rebuilt = F.concat(
        new_head,
        F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise(""),
        F.when(fragment != "", F.concat(F.lit("#"), fragment)).otherwise(""),
    )
    untouched = (query == "") | _bad_brackets(F.regexp_extract(head, _NETLOC, 1))
    return F.when(~F.contains(url, F.lit("?")), url).when(untouched, url).otherwise(rebuilt)
