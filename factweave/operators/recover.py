"""Candidate fact lines from raw model output: lines, JSON in several shapes, and what is left of broken JSON."""

from __future__ import annotations

import ast
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import config as C
from ..functions.columns import any_of, let, once, strip
from .normalize import category_to_cluster, infer_cluster
from .sanitize import looks_like_fact, recovered_line

# Marks of a model's thinking, and of its end.
THINKING = ["thought", "the user wants", "here's my plan", "input:", "output:", "constraints:"]
_KEYS = {"cluster": ["cluster", "Cluster", "CLUSTER", "C", "category", "Category"], "keyword": ["keyword", "Keyword", "KEYWORD", "K"], "value": ["value", "Value", "VALUE", "V"], "ts": ["timestamp", "Timestamp", "TIMESTAMP", "T"]}


# Marks that no text has (noncharacters), put between the parts of a text that is cut in one pass.
_HEAD, _NEXT, _VALUE, _TIME = "\ufdd0", "\ufdd1", "\ufdd2", "\ufdd3"
_ITEM = "array<struct<branch:int,n:int,line:string>>"


def kept_lines(raw: Column) -> Column:
    """The lines of an output as (pos, line), without internal tokens and without thinking.

    A line with a mark of thinking starts a block and is dropped; the block ends with the first line
    that has three pipes or looks like JSON, which stays.
    """

    def event(x: Column) -> Column:
        pipes = F.length(x) - F.length(F.replace(x, F.lit("|"), F.lit("")))
        return let(strip(x), lambda s: F.when(any_of(F.lower(s), THINKING), "t").when((pipes >= 3) | any_of(x, ['{"K"', '"facts"']) | s.startswith("{") | s.startswith("```json"), "p").otherwise("-"))

    def keep(lines: Column) -> Column:
        # one letter a line; a block is its mark and the lines right after it that are nothing else
        told = F.split(F.regexp_replace(F.array_join(F.transform(lines, lambda x: event(x)), ""), r"t|(?!^)\G-", "x"), "")
        placed = F.transform(lines, lambda x, i: F.struct(i.alias("pos"), x.alias("line")))
        return let(told, lambda t: F.filter(placed, lambda x, i: F.get(t, i) != "x"))

    return let(F.split(F.regexp_replace(F.coalesce(raw, F.lit("")), "<unused[0-9]+>", ""), "\r\n|[\n\r]"), keep)


def raw_lines(raw: DataFrame) -> DataFrame:
    """(hadm_id, pos, line) of raw outputs, see ``kept_lines``."""
    return raw.select("hadm_id", F.inline(kept_lines(F.col("raw"))))


def _cleaned(lines: Column) -> Column:
    """The text of kept lines without START, END and fences; null if nothing stays."""
    left = F.filter(F.transform(lines, lambda x: x["line"]), lambda x: ~F.upper(strip(x)).isin("START", "END") & ~strip(x).startswith("```"))
    return let(left, lambda x: F.when(F.size(x) > 0, F.array_join(x, "\n")))


def clean_text(raw: DataFrame) -> DataFrame:
    """(hadm_id, text): the kept lines without START, END and fences."""
    return once(raw, ["hadm_id"], text=_cleaned(kept_lines(F.col("raw")))).filter("text IS NOT NULL")


def _line_of(m: Column, cluster: Column | None = None) -> Column:
    of = lambda k: F.coalesce(*[F.nullif(strip(F.try_element_at(m, F.lit(a))), F.lit("")) for a in _KEYS[k]])
    found = F.struct((of("cluster") if cluster is None else cluster).alias("c"), of("keyword").alias("k"), of("value").alias("v"), of("ts").alias("t"))
    name = lambda x: F.coalesce(category_to_cluster(x["c"]), infer_cluster(x["k"]), F.lit("UNKNOWN"))
    return let(found, lambda x: F.when(x["k"].isNotNull() & x["v"].isNotNull(), F.concat_ws("|", name(x), x["k"], x["v"], F.coalesce(x["t"], F.lit("Unknown")))))


def fact_line(m: Column) -> Column:
    """A fact object (a map of strings) as a line; null without keyword or value."""
    return _line_of(m)


def _items(branch: int, lines: Column, first: int = 0) -> Column:
    """Lines as (branch, n, line), numbered by their places."""
    made = F.transform(lines, lambda x, i: F.struct(F.lit(branch).alias("branch"), (i + first).alias("n"), x.alias("line")))
    return F.coalesce(made, F.array()).cast(_ITEM)


def json_items(text: Column) -> Column:
    """(branch, n, line) of JSON: a list of fact objects, an object with ``facts``, one fact, or lists by cluster."""

    def found(x: Column) -> Column:
        maps = lambda c: F.transform(c, lambda m: fact_line(m))
        some = lambda c: let(c, lambda y: F.when(F.size(y) > 0, maps(y)))
        wrapped = some(F.from_json(x["o"], "facts array<map<string,string>>")["facts"])
        listed = F.when(x["t"].startswith("["), some(F.from_json(x["a"], "array<map<string,string>>")))
        single = let(fact_line(F.from_json(x["o"], "map<string,string>")), lambda y: F.when(y.isNotNull(), F.array(y)))
        lists = F.filter(F.map_entries(F.from_json(x["o"], "map<string,array<map<string,string>>>")), lambda e: F.upper(e["key"]).isin(C.CLUSTERS) & e["value"].isNotNull())
        grouped = F.flatten(F.transform(lists, lambda e: let(F.upper(e["key"]), lambda c: _items(2, F.transform(e["value"], lambda m: F.when(m.isNotNull(), _line_of(m, c)))))))
        return F.concat(_items(1, F.coalesce(wrapped, listed, single)), F.coalesce(grouped, F.array()).cast(_ITEM))

    def cut(t: Column) -> Column:
        whole = F.coalesce(F.nullif(F.regexp_extract(t, r"(?s)(\{.*\})", 1), F.lit("")), t)
        array = F.nullif(F.regexp_extract(t, r"(?s)(\[.*\])", 1), F.lit(""))
        return F.struct(whole.alias("o"), array.alias("a"), t.alias("t"))

    return let(let(strip(text), cut), found)


def _objects(c: Column, within: str = "") -> Column:
    """The innermost objects of a text as maps, whatever the order of their keys; what is cut off or no JSON is left out, and what holds a character of ``within``."""
    found = F.transform(F.regexp_extract_all(c, F.lit(rf"(\{{[^{{}}{within}]*\}})"), F.lit(1)), lambda x: F.from_json(x, "map<string,string>", {"allowSingleQuotes": "true"}))
    return F.filter(found, lambda m: m.isNotNull() & (F.size(m) > 0))


def _has(m: Column, key: str) -> Column:
    return F.exists(F.map_keys(m), lambda k: k.isin(_KEYS[key]))


def _blocks(c: Column, mark: str) -> Column:
    """What follows each mark, up to the next one."""
    return F.filter(F.split(c, mark), lambda x, i: i > 0)


def salvaged_items(text: Column) -> Column:
    """(branch, n, line) of fact objects in cut-off JSON, flat or below a cluster's heading, of «quoted» facts, of told and of inline facts."""
    flat = F.transform(F.filter(_objects(text), lambda m: _has(m, "cluster") & _has(m, "ts")), lambda m: fact_line(m))
    heads = "|".join(C.CLUSTERS)
    marked = F.regexp_replace(text, rf'(?i)"({heads})"\s*:\s*\[', f"{_HEAD}$1{_NEXT}")
    own = lambda b: F.filter(_objects(F.substring_index(b, _NEXT, -1)), lambda m: ~_has(m, "cluster") & _has(m, "ts"))
    grouped = F.flatten(F.transform(_blocks(marked, _HEAD), lambda b: let(F.upper(F.substring_index(b, _NEXT, 1)), lambda c: F.transform(own(b), lambda m: _line_of(m, c)))))
    quoted = F.transform(F.regexp_extract_all(text, F.lit("«([^»]+)»"), F.lit(1)), lambda q: recovered_line(q))
    braces = text.contains("{")
    parts = [_items(3, F.when(braces, flat)), _items(4, F.when(braces, grouped)), _items(5, F.when(text.contains("«"), quoted)), narrative_items(text), inline_items(text)]
    return F.concat(*parts)


def salvaged_facts(text: DataFrame) -> DataFrame:
    """(hadm_id, branch, n, line), see ``salvaged_items``."""
    return text.select("hadm_id", F.inline(salvaged_items(F.col("text"))))


def narrative_items(text: Column) -> Column:
    """(branch, n, line) of facts told field by field, one a line, with or without stars.

    A cluster holds for all keywords up to the next one; a keyword's value and timestamp are the last
    ones before the next keyword or cluster. A fact without a timestamp has an unknown one.
    """
    field = r"(?i)^\*{0,2}(cluster|keyword|value|timestamp)\s*:?\s*\*{0,2}\s*(.+)$"
    marks = {"cluster": _HEAD, "keyword": _NEXT, "value": _VALUE, "timestamp": _TIME}
    kind = lambda x: let(F.lower(F.regexp_extract(x, field, 1)), lambda f: F.when(f == "cluster", _HEAD).when(f == "keyword", _NEXT).when(f == "value", _VALUE).otherwise(_TIME))
    told = F.filter(F.transform(F.split(text, "\n"), lambda x: strip(x)), lambda x: x.rlike(field))
    # all fields in one text, each behind its mark: it is cut at clusters, then at keywords
    whole = F.array_join(F.transform(told, lambda x: F.concat(kind(x), strip(strip(strip(F.regexp_extract(x, field, 2)), "*")))), "")
    own = lambda x: F.regexp_extract(x, f"(?s)^([^{_VALUE}{_TIME}]*)", 1)
    last = lambda x, f: F.regexp_extract(x, f"(?s)^.*{marks[f]}([^{_VALUE}{_TIME}]*)", 1)

    def fact(x: Column, c: Column) -> Column:
        made = F.struct(own(x).alias("k"), last(x, "value").alias("v"), last(x, "timestamp").alias("t"))
        return let(made, lambda m: F.when((m["k"] != "") & (m["v"] != ""), F.concat_ws("|", c, m["k"], m["v"], F.coalesce(F.nullif(m["t"], F.lit("")), F.lit("Unknown")))))

    def facts(block: Column) -> Column:
        rest = _blocks(block, _NEXT)
        return let(own(F.substring_index(block, _NEXT, 1)), lambda c: F.when(c != "", let(category_to_cluster(c), lambda n: F.transform(rest, lambda x: fact(x, n)))))

    lines = F.flatten(F.filter(F.transform(_blocks(whole, _HEAD), facts), lambda x: x.isNotNull()))
    return _items(6, F.when(F.lower(text).contains("keyword"), F.filter(lines, lambda x: x.isNotNull())))


def narrative_facts(text: DataFrame) -> DataFrame:
    """(hadm_id, branch, n, line), see ``narrative_items``."""
    return text.select("hadm_id", F.inline(narrative_items(F.col("text"))))


def inline_items(text: Column) -> Column:
    """(branch, n, line) of fact objects without a cluster that follow text in their line.

    Their cluster is the last one named so far in a line that does not begin with a brace or bracket.
    """
    rows = F.filter(F.transform(F.split(text, "\n"), lambda x: strip(x)), lambda x: ~x.rlike(r"^$|^[{\[]"))

    def headed(s: Column) -> Column:
        heading = F.regexp_extract(F.regexp_replace(s, r"^[*•\-\s]+", ""), r"^([A-Z][A-Z ]{2,})\s*:[\s*]*$", 1)
        inside = F.regexp_extract(F.regexp_replace(s, r"^[*•\-\s]+", ""), rf"(?i)\b({'|'.join(C.CLUSTERS)})\b", 1)
        named = let(F.coalesce(F.nullif(heading, F.lit("")), F.nullif(inside, F.lit(""))), category_to_cluster)
        return let(named, lambda c: F.when(c.isin(C.CLUSTERS), F.concat(F.lit(_HEAD), c, F.lit(_NEXT), s)).otherwise(s))

    def stamped(m: Column) -> Column:
        stamp = F.lower(F.get(F.map_values(F.map_filter(m, lambda k, v: k.isin(_KEYS["ts"]))), F.lit(0)))
        return ~_has(m, "cluster") & F.coalesce(stamp.isin(*[t.lower() for t in C.TIMESTAMPS]), F.lit(False))

    # a new block begins with each line that names a cluster
    whole = F.array_join(F.transform(rows, headed), "\n")
    own = lambda b: F.filter(_objects(F.substring_index(b, _NEXT, -1), r"\n"), stamped)
    lines = F.flatten(F.transform(_blocks(whole, _HEAD), lambda b: let(F.substring_index(b, _NEXT, 1), lambda c: F.transform(own(b), lambda m: _line_of(m, c)))))
    return _items(7, F.when(text.contains("{"), lines), first=1)


def inline_facts(text: DataFrame) -> DataFrame:
    """(hadm_id, branch, n, line), see ``inline_items``."""
    return text.select("hadm_id", F.inline(inline_items(F.col("text"))))


def line_items(lines: Column, allow_kvt3: bool = True) -> Column:
    """(branch, n, line) of lines (pos, line) that look like facts once numbering, bullets and quotes are off."""

    def bare(s: Column) -> Column:
        s = strip(s)
        for pattern in (r"^\[[0-9]+\]\s*", r"^[-*•]\s+", r"^[0-9]+[.)]\s+", r",$", r"""^["'`]+|["'`]+$"""):
            s = F.regexp_replace(s, pattern, "")
        return F.regexp_replace(s, r"^([^|=]+)\|([^|=]+)=([^|]+)$", "$1|$2|$3|Unknown")

    found = F.transform(lines, lambda x: F.struct(F.lit(8).alias("branch"), x["pos"].alias("n"), let(recovered_line(bare(x["line"])), lambda y: F.when(y.isNotNull() & looks_like_fact(y, allow_kvt3), y)).alias("line")))
    return found.cast(_ITEM)


def _literals(text: str | None) -> list[dict[str, str] | None] | None:
    """Fact objects of a text that is a literal of another language's dictionaries and lists."""
    try:
        found = ast.literal_eval(text.strip()) if text else None
    except (ValueError, SyntaxError, MemoryError, RecursionError):
        return None
    found = found.get("facts", [found]) if isinstance(found, dict) else found
    return [{str(k): str(v) for k, v in d.items() if v is not None} if isinstance(d, dict) else None for d in found] if isinstance(found, list) else None


@F.pandas_udf(T.ArrayType(T.MapType(T.StringType(), T.StringType())))
def _literal_maps(texts: pd.Series) -> pd.Series:
    return texts.map(_literals)


def _extracted(raw: DataFrame, allow_kvt3: bool, literals: bool) -> DataFrame:
    """(hadm_id, text, lines): a row per output with its clean text and its fact lines in order.

    A document is one row from end to end: its branches are columns of arrays, so that an output is
    read once, whatever it holds, and nothing is shuffled.
    """
    rows = once(raw, ["hadm_id"], _k=kept_lines(F.col("raw")))
    rows = once(rows, ["hadm_id", "_k"], text=_cleaned(F.col("_k")))
    if literals:
        # rare, and the one place for a Python function
        odd = strip(F.col("text")).rlike(r"^[\[{].*'") & F.from_json("text", "map<string,string>").isNull()
        rows = once(rows, ["hadm_id", "_k", "text"], _odd=F.when(odd, F.col("text"))).withColumn("_odd", _literal_maps("_odd"))
        told = _items(1, F.transform("_odd", lambda m: fact_line(m)))
    else:
        told = F.array().cast(_ITEM)
    valid = lambda x: F.filter(x, lambda y: y["line"].isNotNull())
    rows = once(rows, ["hadm_id", "_k", "text"], _p=valid(F.concat(json_items(F.col("text")), told)))
    rest = F.concat(salvaged_items(F.col("text")), line_items(F.col("_k"), allow_kvt3))
    both = F.when(F.exists("_p", lambda x: x["branch"] == 1), F.col("_p")).otherwise(F.concat("_p", valid(rest)))
    return once(rows, ["hadm_id", "text"], lines=F.array_distinct(F.transform(F.array_sort(both), lambda x: x["line"])))


def extract_facts(raw: DataFrame, allow_kvt3: bool = True, literals: bool = True) -> DataFrame:
    """(hadm_id, pos, line) of raw outputs (hadm_id, raw), one a document: all branches in order, the first of equal lines.

    Flat JSON that parses ends the search for its document; lists by cluster do not, so what the
    other branches find is added to them.
    """
    found = _extracted(raw, allow_kvt3, literals).select("hadm_id", F.posexplode("lines").alias("pos", "line"))
    return found.select("hadm_id", (F.col("pos") + 1).cast("bigint").alias("pos"), "line")


def json_mode_facts(raw: DataFrame) -> DataFrame:
    """The lines of ``extract_facts``; a document without any gives the complete objects of its cut-off JSON, values without leading dollar signs."""
    of = lambda t, k: strip(F.coalesce(F.get_json_object(t, f"$.{k}"), F.get_json_object(t, f"$.{k.upper()}")))

    def line(t: Column) -> Column:
        made = F.struct(of(t, "cluster").alias("c"), of(t, "keyword").alias("k"), strip(F.ltrim(of(t, "value"), F.lit("$"))).alias("v"), of(t, "timestamp").alias("t"))
        return let(made, lambda x: F.when(x["c"].isNotNull() & x["k"].isNotNull() & x["t"].isNotNull(), F.concat_ws("|", x["c"], x["k"], x["v"], x["t"])))

    objects = F.transform(F.regexp_extract_all("text", F.lit(r"(\{[^{}]*\})"), F.lit(1)), line)
    rows = _extracted(raw, True, True).select("hadm_id", F.posexplode(F.when(F.size("lines") > 0, F.col("lines")).otherwise(objects)).alias("pos", "line"))
    return rows.select("hadm_id", (F.col("pos") + 1).cast("bigint").alias("pos"), "line").filter("line IS NOT NULL")


def first_json_object(c: Column) -> Column:
    """The JSON object that begins at a text's first brace, without what follows it; null if there is none.

    If that is no valid JSON, all from the first brace to the last is taken with the line breaks
    inside its strings escaped.
    """
    made = _objects_at(c)
    parse = lambda x: F.when(F.try_parse_json(x).isNotNull(), x)
    return F.coalesce(parse(made["first"]), parse(made["healed"]))


_MARK = re.compile(r'["{}\\\n\r]')
_BREAKS = {"\n": "\\n", "\r": "\\r"}


def scan_object(text: str | None) -> tuple[str | None, str | None]:
    """The object that begins at the first brace, and all from there to the last brace with line breaks in strings escaped.

    One walk over the positions of quotes, braces, escapes and line breaks; no text is built on the way.
    """
    begin, end = (text.find("{"), text.rfind("}")) if text else (-1, -1)
    if begin < 0 or end < begin:
        return None, None
    body = text[begin : end + 1]
    depth, inside, spared, first = 0, False, -1, None
    cuts: list[int] = []
    for m in _MARK.finditer(body):
        at, mark = m.start(), m[0]
        if inside:
            if at == spared:
                continue
            if mark == '"':
                inside = False
            elif mark == "\\":
                spared = at + 1
            elif mark in _BREAKS:
                cuts.append(at)
        elif mark == '"':
            inside = True
        elif mark == "{":
            depth += 1
        elif mark == "}":
            depth -= 1
            if depth == 0 and first is None:
                first = at + 1
    edges = [0, *(x for at in cuts for x in (at, at + 1)), len(body)]
    healed = "".join(body[a:b] if k % 2 == 0 else _BREAKS[body[a]] for k, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)))
    return (body[:first] if first else None), healed


@F.pandas_udf(T.StructType().add("first", "string").add("healed", "string"))
def _objects_at(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([scan_object(t) for t in texts], columns=["first", "healed"])
