"""Scalar functions of the corpus model as Column expressions."""

from __future__ import annotations

from functools import reduce
from itertools import chain
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import model


def _lookup(table: dict[str, str], key: Column) -> Column:
    return F.create_map(*[F.lit(x) for x in chain.from_iterable(table.items())])[key]


def utf16_units(text: Column) -> Column:
    return (F.octet_length(F.encode(text, "UTF-16LE")) / 2).cast("long")


def estimate_tokens(text: Column) -> Column:
    return F.ceil(utf16_units(text) / 4).cast("long")


def extension(path: Column) -> Column:
    """Lower-case text after the last dot; empty without one."""
    return F.lower(F.regexp_extract(path, r"\.([^.]*)$", 1))


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def dirname(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def language(path: Column) -> Column:
    return _lookup(model.LANGUAGES, extension(path))


def comment_prefix(lang: Column) -> Column:
    return F.when(lang.isin("python", "ruby"), "#").otherwise("//")


def display_extension(path: Column) -> Column:
    return F.coalesce(_lookup(model.SHORT_LANGUAGE, language(path)), extension(path))


def fence(path: Column) -> Column:
    return F.coalesce(_lookup(model.FENCES, extension(path)), F.lit(""))


def flags(path: Column) -> Column:
    """The markers of a file that hold, in a fixed order: test, docs, workflow or action, config.

    The directory markers need a slash before them, so a directory at the root has none.
    """
    low, name = F.lower(path), F.lower(basename(path))
    test = low.rlike(model.TEST_DIRECTORIES) | name.rlike(model.TEST_NAME)
    docs = name.rlike(model.DOC_NAME) | low.rlike(model.DOC_DIRECTORIES)
    flow = F.when(low.rlike(model.WORKFLOW_PATH), "workflow").when(name.isin(model.ACTION_FILES), "action")
    config = name.isin(model.CONFIG_NAMES) | name.rlike("|".join(model.CONFIG_PATTERNS))
    return F.array_compact(F.array(F.when(test, "test"), F.when(docs, "docs"), flow, F.when(config, "config")))


def result_type(path: Column) -> Column:
    """What kind of file a search result is, by the first of its markers."""
    name = F.lower(basename(path))
    parts = F.split(F.lower(path), "/")
    config = F.exists(parts, lambda x: reduce(or_, (x.startswith(n) for n in model.CONFIG_HEADS)))
    action = reduce(or_, (path.endswith(n) for n in model.ACTION_NAMES))
    kinds = [("workflow", path.contains(model.WORKFLOW_DIRECTORY)), ("action", action), ("documentation", name.endswith(".md") | name.endswith(".mdx")), ("config", config)]
    return F.coalesce(*[F.when(holds, kind) for kind, holds in kinds], F.lit("code"))


def snippet(text: Column, length: int = 320) -> Column:
    return F.substring(F.trim(F.regexp_replace(text, r"(?U)\s+", " ")), 1, length)


def chunk_strategy(path: Column) -> Column:
    """How a file is cut: headings, whole, ast or tokens."""
    p = F.lower(F.regexp_replace(path, r"\\", "/"))
    return (
        F.when(p.rlike(r"\.mdx?$"), "headings")
        .when(p.contains(".github/workflows/") & p.rlike(r"\.ya?ml$"), "whole")
        .when(basename(p).isin("action.yml", "action.yaml"), "whole")
        .when(language(p).isNotNull(), "ast")
        .otherwise("tokens")
    )


def yaml_scalar(text: Column, key: str) -> Column:
    """The value of a top-level key without one pair of quotes; null if the key is absent."""
    found = F.regexp_extract(text, rf"(?m)^{key}:[ \t]*(\S.*)$", 1)
    return F.when(found != "", F.regexp_replace(F.trim(found), "^['\"]|['\"]$", ""))


def _section(text: Column, key: str) -> Column:
    """What follows a top-level key, up to the next line that is blank or not indented; null without it."""
    own = F.get(F.filter(F.split(text, r"(?m)^(?=\S)"), lambda x: x.startswith(f"{key}:")), F.lit(0))
    return F.substr(F.get(F.split(own, r"\n[ \t]*(?=\n|$)"), F.lit(0)), F.lit(len(key) + 2))


def workflow_triggers(text: Column) -> Column:
    """Triggers of a workflow: an inline list, one word, or the keys of a block (two blanks deep)."""
    section = F.coalesce(_section(text, "on"), F.lit(""))
    value = F.regexp_replace(section, r"^\s+", "")
    first = F.rtrim(F.substring_index(value, "\n", 1))
    items = F.transform(F.split(F.substring_index(F.substr(value, F.lit(2)), "]", 1), ","), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))
    keys = F.regexp_extract_all(section, F.lit(r"(?m)^[ \t]{2}(\w[\w-]*):"), F.lit(1))
    return F.when(value.startswith("["), F.filter(items, lambda x: x != "")).when(first.rlike(r"^\w[\w-]*$"), F.array(first)).otherwise(keys)


def action_inputs(text: Column) -> Column:
    """Inputs of an action, each with its name and whether the lines below it require it."""
    key = r"  \w[\w-]*:[ \t]*"
    parts = F.filter(F.split(F.coalesce(_section(text, "inputs"), F.lit("")), rf"(?m)^(?={key}$)"), lambda x: x.rlike(rf"^{key}(\n|$)"))
    return F.transform(parts, lambda x: F.struct(F.regexp_extract(x, r"\w[\w-]*", 0).alias("name"), x.rlike(r"required:\s*true").alias("required")))


def repo_of_url(url: Column, host: str = r"github\.com") -> Column:
    """Owner and repository of an https or ssh address of the host; null for any other address."""
    u = F.trim(url)
    pattern = rf"(?i)^(?:git@{host}:|https?://(?:www\.)?{host}/)([^/\s]+)/([^/.\s?#]+)"
    owner, repo = F.regexp_extract(u, pattern, 1), F.regexp_extract(u, pattern, 2)
    return F.when(owner != "", F.struct(owner.alias("owner"), repo.alias("repo")))


def repo_url_error(url: Column, host: str = r"github\.com") -> Column:
    """Why an address names no repository: empty, enterprise (one on another host, which is not supported) or invalid; null where it does.

    Stricter than ``repo_of_url``: a name with a dot, other than the ending .git, is invalid.
    """
    u = F.trim(F.regexp_replace(url, r"(?U)^\s+|\s+$", ""))
    valid = u.rlike(rf"^https?://{host}/[^/]+/[^/.]+?(\.git)?(/.*)?$") | u.rlike(rf"^git@{host}:[^/]+/[^/.]+?(\.git)?$")
    elsewhere = u.rlike(rf"^https?://(?!{host}\b)[^/]+/[^/]+/[^/]+") & ~u.rlike(host)
    return F.when(F.coalesce(u, F.lit("")) == "", "empty").when(valid, F.lit(None)).when(elsewhere, "enterprise").otherwise("invalid")


def readme_scope(path: Column) -> Column:
    return F.regexp_replace(path, "^/+|/+$", "")


def split_patterns(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, ","), lambda x: F.trim(x)), lambda x: x != "")


def cost(tokens: Column, price_per_million: Column) -> Column:
    """A price as text: nothing for a free model, else dollars with two decimals."""
    value = tokens / 1e6 * price_per_million
    return (
        F.when(price_per_million == 0, "")
        .when(value == 0, "$0.00")
        .when(value < 0.01, "<$0.01")
        .otherwise(F.concat(F.lit("$"), F.regexp_replace(F.format_number(value, 2), ",", "")))
    )


def thousands(n: Column) -> Column:
    return F.format_number(n, 0)


def byte_size(n: Column) -> Column:
    return F.when(n < 1_000_000, F.concat(F.round(n / 1000).cast("long").cast("string"), F.lit(" KB"))).otherwise(
        F.concat(F.regexp_replace(F.format_number(n / 1e6, 1), ",", ""), F.lit(" MB"))
    )


def short_sha(sha: Column) -> Column:
    return F.substring(sha, 1, 7)


def humanized(kind: Column) -> Column:
    return F.initcap(F.regexp_replace(kind, "[-_]", " "))


def file_key(source: Column, path: Column) -> Column:
    return F.concat_ws(":", source, path)


def scope_key(ids: Column) -> Column:
    return F.array_join(F.array_sort(ids), ",")


def fingerprint(*columns: Column) -> Column:
    return F.sha2(F.to_json(F.struct(*columns)), 256)


def path_relevance(query: str, path: Column) -> Column:
    """The share of the query's words, of two characters or more, that the lower-case path contains."""
    words = [w for w in query.lower().split() if len(w) >= 2]
    if not words:
        return F.lit(0.0)
    return sum((F.lower(path).contains(w).cast("int") for w in words), F.lit(0)) / len(words)


def stage_error(*parts: Column) -> Column:
    """The parts that are not null, joined by a middle dot."""
    return F.concat_ws(" · ", *parts)


def model_width(name: Column) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for kv in model.MODEL_WIDTHS.items() for x in kv])[name], F.lit(1536))


def rounded_score(score: Column) -> Column:
    return F.round(score, 6)


def custom_patterns(given: Column, default: list[str]) -> Column:
    """Whether two pattern sets differ, order aside."""
    known = F.array(*[F.lit(x) for x in default]) if default else F.array().cast("array<string>")
    return (F.size(F.array_except(given, known)) > 0) | (F.size(F.array_except(known, given)) > 0)
