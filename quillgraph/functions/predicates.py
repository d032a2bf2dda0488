"""Scalar rules of the graph as Column expressions; all stay inside code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names too general to be a contract token (compared in lower case).
GENERAL_NAMES = "id type name version host url uri state status data value time date code error message sn key description title summary action channel address reply examples properties required enum format items schema".split()
# Routes that every service has (lower case, no closing slash).
GENERAL_ROUTES = "/ /health /healthz /health/live /health/ready /metrics /status /ping /ready /readyz /live /livez /version /favicon.ico /robots.txt /api /api/v1 /api/v2 /v1 /v2 /index".split()
# Environment variables that every program has (upper case).
GENERAL_ENV = "DATABASE_URL REDIS_URL REDIS_HOST NODE_ENV PORT HOST HOSTNAME LOG_LEVEL DEBUG PATH HOME PWD USER SHELL TERM LANG TZ CI TMPDIR AWS_REGION AWS_PROFILE HTTP_PROXY HTTPS_PROXY".split()
# Names that a linear reading leaves out.
TRIVIAL_NAMES = (
    "equals hashCode toString copy component1 component2 component3 component4 component5 let also apply run with takeIf takeUnless require "
    "requireNotNull check checkNotNull error TODO to print println invoke getValue setValue provideDelegate lazy emptyList emptyMap emptySet "
    "listOf mapOf setOf mutableListOf mutableMapOf buildList d e i w v"
).split()
CHARS_PER_TOKEN = 3.5


def is_test(path: Column) -> Column:
    """Whether a path is of a test, as queries see it: a top-level `test/x` is not."""
    return F.coalesce(path.contains("tests/") | path.contains("/test/") | path.contains(".test.") | path.contains("_test.") | path.contains("/test_"), F.lit(False))


def is_test_segment(path: Column) -> Column:
    """Whether a path is of a test, as the linear reading sees it: by path segment or by the form of the file name."""
    segment = path.rlike(r"(^|/)(tests?|__tests__|testFixtures|androidTest|spec)(/|$)")
    name = F.element_at(F.split(path, "/"), -1)
    return F.coalesce(segment | name.rlike(r"^test_.*\.\w+$|(_test|\.test|\.spec|Test|Tests|Spec|IT)\.\w+$"), F.lit(False))


def is_trivial(name: Column) -> Column:
    """Names not worth following: a fixed set, accessors, single letters."""
    return name.isin(*TRIVIAL_NAMES) | name.rlike(r"^(?:get|set|is|has)[A-Z]\w*$") | (F.length(name) <= 1)


def is_distinctive(token: Column) -> Column:
    """Whether a token can tell a contract from others."""
    slashless = F.regexp_replace(F.lower(token), "/+$", "")
    spaced = token.rlike(r"\s")
    return F.coalesce(
        F.when(token == "", False)
        .when(token.contains("/"), ~slashless.isin(*GENERAL_ROUTES) & (F.length(token) >= 5))
        .when(F.lower(token).isin(*GENERAL_NAMES), False)
        .when(F.upper(token).isin(*GENERAL_ENV), False)
        .when((token.contains(".") | token.contains(":")) & (F.length(token) >= 5) & ~spaced, True)
        .when(token.contains("_") & (F.length(token) >= 6), True)
        .otherwise(token.rlike(r"^[A-Za-z]{10,}$")),
        F.lit(False),
    )


def normalize_address(address: Column) -> Column:
    """A path without its parameter segments (null if none is left); other addresses as they are."""
    parts = F.filter(F.split(address, "/"), lambda s: (s != "") & ~s.contains("{"))
    return F.when(~address.contains("/"), address).when(F.size(parts) > 0, F.concat(F.lit("/"), F.array_join(parts, "/")))


def asyncapi_path(route: Column) -> Column:
    """A route with its parameters as {name} and without empty segments."""
    parts = F.filter(F.split(route, "/"), lambda s: s != "")
    named = F.transform(parts, lambda s: F.when(s.startswith(":"), F.concat(F.lit("{"), F.regexp_replace(s, "^:", ""), F.lit("}"))).when(s.rlike("^<.*>$"), F.regexp_replace(F.regexp_replace(s, "^<", "{"), ">$", "}")).otherwise(s))
    return F.concat(F.lit("/"), F.array_join(named, "/"))


def channel_key(kind: Column, token: Column) -> Column:
    plain = F.regexp_replace(F.regexp_replace(token, r"[{}]", ""), r"[^A-Za-z0-9]+", "-")
    return F.lower(F.concat_ws("-", kind, F.regexp_replace(plain, "^-+|-+$", "")))


def route_path(literal: Column) -> Column:
    """The path of a URL or of a literal that starts with a slash, up to its query; else null."""
    url = F.regexp_extract(literal, r"^https?://[^/]+(/[^\s?#]*)", 1)
    return F.when(url != "", url).when(literal.startswith("/"), F.regexp_extract(literal, r"^([^?#]*)", 1))


def utf16_length(text: Column) -> Column:
    return (F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("long")


def est_tokens(text: Column) -> Column:
    """Estimated tokens of a text; lengths count UTF-16 units."""
    return F.coalesce(F.ceil(utf16_length(text) / F.lit(CHARS_PER_TOKEN)).cast("long"), F.lit(0))


def is_identifier(text: Column) -> Column:
    return F.coalesce(text.rlike(r"^[A-Za-z_][A-Za-z0-9_]*$"), F.lit(False))


def name_contains(name: Column, part: str) -> Column:
    """Case-insensitive containment in which % and _ of `part` stand for any run and any character."""
    return F.lower(name).like("%" + part.lower() + "%")


def compact(n: Column) -> Column:
    """A number in a few characters: 940, 1.6K, 277K, 1.9M."""
    a = F.abs(n)
    k = n / 1e3
    return (
        F.when(a >= 1e6, F.concat(F.format_number(n / 1e6, 1), F.lit("M"))).when((a >= 1e3) & (k >= 10), F.concat(F.round(k).cast("long").cast("string"), F.lit("K")))
        .when(a >= 1e3, F.concat(F.format_number(k, 1), F.lit("K"))).otherwise(F.format_number(F.round(n), 0))
    )
