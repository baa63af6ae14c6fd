"""Page URLs: one form for all addresses of a page."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Query parameters that only track visits.
TRACKING = ("fbclid", "gclid", "mc_cid", "mc_eid", "ref_src")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value as a variable, so that a plan holds and evaluates its expression once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _encoded(text: Column, kept: str) -> Column:
    """Characters outside of `kept` (a character class) as %XX of their UTF-8 bytes; what is encoded stays as it is."""
    one = lambda c: F.when(c.rlike(f"^[%{kept}]$"), c).otherwise(F.replace(F.url_encode(c), F.lit("+"), F.lit("%20")))
    return F.when(text.rlike(f"^[%{kept}]*$"), text).otherwise(F.array_join(F.transform(F.split(text, ""), one), ""))


_DIGITS = "abcdefghijklmnopqrstuvwxyz0123456789"
# Fixed values of the bootstring coding of host names.
_BASE, _LEAST, _MOST, _SKEW, _DAMP, _BIAS, _FIRST = 36, 1, 26, 38, 700, 72, 128


def _number(delta: Column, bias: Column) -> Column:
    """A number as digits of varying weight, the last of which tells that it is the last."""
    def digit(s: Column, k: Column) -> Column:
        t = F.greatest(F.lit(_LEAST), F.least(F.lit(_MOST), k - bias)).cast("long")
        more = s["left"] >= t
        at = F.when(more, t + F.pmod(s["left"] - t, _BASE - t)).otherwise(s["left"])
        told = F.concat(s["out"], F.substr(F.lit(_DIGITS), at.cast("int") + 1, F.lit(1)))
        return F.when(s["left"] < 0, s).otherwise(F.struct(F.when(more, F.floor((s["left"] - t) / (_BASE - t))).otherwise(F.lit(-1)).cast("long").alias("left"), told.alias("out")))

    return F.aggregate(F.sequence(F.lit(_BASE), F.lit(12 * _BASE), F.lit(_BASE)), F.struct(delta.cast("long").alias("left"), F.lit("").alias("out")), digit, lambda s: s["out"])


def _adapted(delta: Column, points: Column, first: Column) -> Column:
    """The bias for the next number, after one that stood for so many characters."""
    start = let(F.floor(delta / F.when(first, _DAMP).otherwise(2)).cast("long"), lambda d: d + F.floor(d / points).cast("long"))
    limit = (_BASE - _LEAST) * _MOST // 2
    step = lambda s, _: F.when(s["d"] > limit, F.struct(F.floor(s["d"] / (_BASE - _LEAST)).cast("long").alias("d"), (s["k"] + _BASE).alias("k"))).otherwise(s)
    return F.aggregate(F.sequence(F.lit(1), F.lit(8)), F.struct(start.alias("d"), F.lit(0).alias("k")), step, lambda s: s["k"] + F.floor(_BASE * s["d"] / (s["d"] + _SKEW)).cast("int"))


def _ascii_label(label: Column) -> Column:
    """A part of a host name in ASCII: its characters beyond, in order of code point and place, as distances in the row of all (place, code point)."""
    points = F.transform(F.sequence(F.lit(1), F.length(label)), lambda k: F.ascii(F.substr(label, k, F.lit(1))))

    def coded(all_: Column) -> Column:
        plain = F.regexp_replace(label, r"[^\x00-\x7F]", "")
        beyond = F.array_sort(F.filter(F.transform(all_, lambda c, k: F.struct(c.alias("c"), k.alias("at"))), lambda x: x["c"] >= _FIRST))
        below = lambda c, start, end: F.size(F.filter(all_, lambda x, k: (x < c) & (k >= start) & (k < end)))

        def step(s: Column, e: Column) -> Column:
            same = s["c"] == e["c"]
            rest = F.when(s["at"] < 0, 0).otherwise(below(s["c"], s["at"] + 1, F.size(all_)) + 1)
            passed = F.when(s["at"] < 0, e["c"] - _FIRST).otherwise(e["c"] - s["c"] - 1).cast("long") * (s["done"] + 1)
            delta = F.when(same, below(e["c"], s["at"] + 1, e["at"])).otherwise(rest + passed + below(e["c"], F.lit(0), e["at"])).cast("long")
            return let(delta, lambda d: F.struct(e["c"].alias("c"), e["at"].alias("at"), (s["done"] + 1).alias("done"), _adapted(d, s["done"] + 1, s["done"] == F.length(plain)).alias("bias"), F.concat(s["out"], _number(d, s["bias"])).alias("out")))

        start = F.struct(F.lit(0).alias("c"), F.lit(-1).alias("at"), F.length(plain).alias("done"), F.lit(_BIAS).alias("bias"), F.concat(plain, F.when(plain != "", "-").otherwise("")).alias("out"))
        return F.concat(F.lit("xn--"), F.aggregate(beyond, start, step, lambda s: s["out"]))

    return let(points, coded)


def ascii_host(host: Column) -> Column:
    """A host name, with its port if it has one, as it is sent: parts with other characters than ASCII in their ASCII form. Cases are as they come."""
    other = r"[^\x00-\x7F]"
    parts = F.transform(F.split(F.regexp_extract(host, r"^([^:]*)", 1), r"[.\x{3002}\x{FF0E}\x{FF61}]", -1), lambda x: F.when(x.rlike(other), _ascii_label(x)).otherwise(x))
    return F.when(host.rlike(other), F.concat(F.array_join(parts, "."), F.regexp_extract(host, r"^[^:]*(.*)$", 1))).otherwise(host)


def _resolved(path: Column) -> Column:
    """The path without dot segments."""
    steps = F.split(F.substr(path, F.lit(2)), "/", -1)
    dots = lambda s: F.length(F.regexp_replace(s, "(?i)%2e", "."))
    onto = lambda done, s: F.when(~s.rlike(r"(?i)^(\.|%2e){1,2}$"), F.concat(done, F.array(s))).when(dots(s) == 1, done).otherwise(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))))
    kept = F.aggregate(steps, F.array().cast("array<string>"), onto)
    ended = F.when(path.rlike(r"(?i)/(\.|%2e){1,2}$"), F.concat(kept, F.array(F.lit("")))).otherwise(kept)
    return F.when(path.rlike(r"(?i)/(\.|%2e){1,2}(/|$)"), F.concat(F.lit("/"), F.array_join(ended, "/"))).otherwise(path)


def normalize_page_url(url: Column) -> Column:
    """Scheme and host in lower case, without a default port; no dot segments; no tracking parameters, the rest decoded, sorted by name
    and value and encoded as a form's; no fragment but a route (#/ or #!/); no slash at the end of a path; other characters
    than an address may hold as %XX; hosts in ASCII form. Null for what isn't an http(s) URL."""
    given = F.regexp_replace(F.regexp_replace(url, r"^[\x00-\x20]+|[\x00-\x20]+$", ""), r"[\t\n\r]", "")
    whole = r"(?s)^([A-Za-z][A-Za-z0-9+.-]*):[/\\]+([^/?#\\]*)([^?#]*)(?:\?([^#]*))?(#.*)?$"
    parts = lambda x: F.struct(*(F.regexp_extract(x, whole, k).alias(n) for k, n in enumerate(("scheme", "site", "path", "query", "fragment"), 1)))
    made = let(given, lambda x: F.when(x.rlike(r"(?i)^https?:[/\\]+[^/?#\\]+"), let(parts(x), _joined)))
    return F.when(url.isNotNull(), made)


def _joined(part: Column) -> Column:
    """A page's address from its parts; null without a host."""
    scheme = F.lower(part["scheme"])
    host = F.regexp_replace(F.lower(F.regexp_replace(part["site"], "^.*@", "")), r":0*(\d+)$|:$", F.lit(":$1"))
    host = F.regexp_replace(host, F.when(scheme == "http", ":(80)?$").otherwise(":(443)?$"), F.lit(""))
    ended = lambda p: F.when((F.length(p) > 1) & p.endswith("/"), F.substr(p, F.lit(1), F.length(p) - 1)).otherwise(p)
    path = let(F.translate(part["path"], "\\", "/"), lambda p: F.when(p == "", "/").otherwise(p))
    path = let(let(let(path, _resolved), ended), lambda p: _encoded(p, r"!$&'()*+,\-./0-9:;=@A-Z\[\]_a-z|~"))
    plain = lambda x: F.coalesce(F.try_url_decode(x), x)
    pairs = F.transform(F.filter(F.split(part["query"], "&"), lambda p: p != ""), lambda p: F.struct(plain(F.regexp_extract(p, "^([^=]*)", 1)).alias("n"), plain(F.regexp_extract(p, "(?s)^[^=]*=?(.*)$", 1)).alias("v")))
    told = F.array_sort(F.filter(pairs, lambda p: ~F.lower(p["n"]).startswith("utm_") & ~F.lower(p["n"]).isin(*TRACKING)))
    search = F.array_join(F.transform(told, lambda p: F.concat(F.url_encode(p["n"]), F.lit("="), F.url_encode(p["v"]))), "&")
    query = let(search, lambda x: F.when(x == "", "").otherwise(F.concat(F.lit("?"), x)))
    route = F.when(part["fragment"].rlike("^#!?/"), _encoded(part["fragment"], r"!#$&'()*+,\-./0-9:;=?@A-Z\[\\\]^_a-z{|}~")).otherwise("")
    user = F.regexp_extract(part["site"], "^(.*@)?", 1)
    return let(ascii_host(host), lambda h: F.when(h != "", F.concat(scheme, F.lit("://"), user, h, path, query, route)))


def page_key(tab: Column, url: Column) -> Column:
    return F.concat_ws(":", tab.cast("string"), normalize_page_url(url))


def hostname(url: Column) -> Column:
    """The host, without port; the input itself if it isn't a URL."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return F.when(host != "", host).otherwise(url)


def is_supported(url: Column) -> Column:
    return F.coalesce(url.rlike("(?i)^https?://"), F.lit(False))
