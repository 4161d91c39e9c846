"""Secrets in texts, and how many repositories and owners hold each of them.

Three fixed kinds of span are found first: values assigned to a telling name, access keys and
hexadecimal strings.  They stay as they are.  Between the matches of the first kind, every token of
``MIN_TOKEN`` or more token characters that looks alive (letters and digits, many different
characters) and holds no span of the other two kinds is a candidate.  The
values of all spans and candidates, in lower case, are hashed and aggregated over the whole
corpus: in how many distinct repositories (documents) and by how many distinct owners (sources)
does the value stand?  A value of more than ``max_owners`` owners is a widely copied example;
any other live-looking value belongs to its owner and counts as a live credential.  Candidates
that belong to their owner become spans of a fourth kind, ``owned``; examples do not.

Everything is DataFrame functions.  Positions come from splitting a text at the matches: a match
starts after the lengths of all parts and matches before it.  The texts are read once; what was
found in each row goes to a table of its own, which has no texts.  Owners and repositories are
counted from distinct (value, owner) and (value, repository) rows, which the map side combines, so a
value in a third of all documents is no large group.  Verdicts return to the rows by a join; the
values of more than a thousandth of all occurrences, at most a thousand, are broadcast instead.

Defined results: a null or empty text has no spans, zero counts and the digest of the empty
string.  A null owner or repository is one owner or repository of its own.  Repeated rows give
repeated results, and count as one repository.  Spans that start together are listed in the order
assign, access, hex, owned.  An empty table gives no rows.  Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paddock.scratch import materialise, materialise_counted


def _either(word: str) -> str:
    """A pattern for ASCII letters in either case; other characters stay."""
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


#: Patterns of the kinds, with their shortest valid value.
ASSIGN = (
    "(" + "|".join(_either(w) for w in ("password", "passwd", "secret", "token", "api_?key")) + ")"
    "[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
ASSIGN_VALUE = 12
# A match of these two is a whole run of its class (from the first AKIA on), so a shortest length asks the same as dropping short matches.
ACCESS = "AKIA[A-Z0-9]{14,}"
HEX = "[0-9a-f]{16,}"
KINDS = ("assign", "access", "hex", "owned")

#: Parameters of candidates: shortest token, fewest letters and digits, fewest different characters.
MIN_TOKEN, MIN_LETTERS, MIN_DIGITS, MIN_DIFFERENT = 16, 2, 2, 8
TOKEN = f"[A-Za-z0-9+/_=-]{{{MIN_TOKEN},}}"
#: A value of more owners is an example.
MAX_OWNERS = 2
#: A value with more than this part of all occurrences has its verdict broadcast.
HOT_PART = 1000
BLOCK = 256
SPANS = "array<struct<start:int,end:int,kind:int,value:string>>"


def _gate(text: Column, kind: str) -> Column:
    """A cheap condition that every text with a match meets."""
    if kind == "assign":
        low = F.lower(text)
        return low.contains("passw") | low.contains("secret") | low.contains("token") | low.contains("api_key") | low.contains("apikey")
    return {"access": text.contains("AKIA"), "hex": text.rlike(HEX), "owned": text.rlike("[0-9]")}[kind]


def _placed(steps: Column, kind: str, at: Column) -> Column:
    """Spans of a short list of (part, match, value), with a running position from ``at`` on."""
    span = lambda at, s: F.struct(
        at.alias("start"), (at + F.length(s["match"])).alias("end"), F.lit(KINDS.index(kind)).alias("kind"), s["value"].alias("value")
    )
    return F.aggregate(
        steps, F.struct(at.alias("at"), F.array().cast(SPANS).alias("held")),
        lambda acc, s: F.struct(
            (acc["at"] + F.length(s["part"]) + F.length(s["match"])).alias("at"),
            F.concat(acc["held"], F.array(span(acc["at"] + F.length(s["part"]), s))).alias("held"),
        ),
        lambda acc: acc["held"],
    )


def _spans(text: Column, kind: str, pattern: str, value_group: int = 0) -> Column:
    """(start, end, kind, value) of each match, in text order; ends are exclusive.

    Appending to a list copies it, so matches are placed in blocks of ``BLOCK``: first where each
    block starts, then the matches in it.
    """
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(value_group)) if value_group else matches
    parts = F.split(text, pattern)
    steps = F.arrays_zip(F.slice(parts, 1, F.size(matches)).alias("part"), matches.alias("match"), values.alias("value"))
    blocks = F.transform(F.sequence(F.lit(0), F.ceil(F.size(steps) / BLOCK).cast("int") - 1), lambda k: F.slice(steps, k * BLOCK + 1, BLOCK))
    sizes = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), lambda n, s: n + F.length(s["part"]) + F.length(s["match"])))
    starts = F.aggregate(sizes, F.array(F.lit(0)), lambda acc, n: F.concat(acc, F.array(F.element_at(acc, -1) + n)))
    found = F.when(F.size(steps) > 0, F.flatten(F.zip_with(blocks, F.slice(starts, 1, F.size(blocks)), lambda b, at: _placed(b, kind, at))))
    return F.coalesce(F.when(_gate(text, kind), found), F.array().cast(SPANS))


def _live_looking(value: Column) -> Column:
    letters = F.length(F.regexp_replace(value, "[^A-Za-z]", ""))
    digits = F.length(F.regexp_replace(value, "[^0-9]", ""))
    different = F.size(F.array_distinct(F.split(F.lower(value), "")))
    return (letters >= MIN_LETTERS) & (digits >= MIN_DIGITS) & (different >= MIN_DIFFERENT)


def _line(spans: Column) -> Column:
    """``kind:start:end`` of sorted spans, joined by commas."""
    name = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.element_at(name, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def _sorted(spans: Column) -> Column:
    """By start, then kind."""
    parts = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), s["value"].alias("value")))
    return F.array_sort(parts)


def _found(docs: DataFrame, key: str, text: str, owner: str, repository: str) -> DataFrame:
    """One row per document: counts of the base kinds, their spans, and the candidates."""
    held = docs.select(
        docs[key].cast("bigint").alias("doc_id"), docs[owner].cast("string").alias("owner"), docs[repository].cast("string").alias("repository"),
        F.coalesce(docs[text].cast("string"), F.lit("")).alias("text"),
    )
    raw = held.select(
        "doc_id", "owner", "repository", "text",
        _spans(F.col("text"), "assign", ASSIGN, 2).alias("assign"),
        _spans(F.col("text"), "access", ACCESS).alias("access"),
        _spans(F.col("text"), "hex", HEX).alias("hex"),
    )
    # Candidates stand between assigned values, so no candidate overlaps one.
    between = F.when(F.size("assign") > 0, F.split("text", ASSIGN)).otherwise(F.array("text"))
    starts = F.concat(F.array(F.lit(0)), F.transform("assign", lambda s: s["end"]))
    # Access keys and hexadecimal strings lie wholly inside a token, so its own text tells whether it holds one.
    wanted = lambda s: _live_looking(s["value"]) & ~s["value"].rlike(f"{ACCESS}|{HEX}")
    moved = lambda s, at: F.struct(
        (s["start"] + at).alias("start"), (s["end"] + at).alias("end"), s["kind"].alias("kind"), s["value"].alias("value")
    )
    tokens = F.flatten(
        F.zip_with(between, starts, lambda part, at: F.transform(F.filter(_spans(part, "owned", TOKEN), wanted), lambda s: moved(s, at)))
    )
    base = raw.select(
        "doc_id", "owner", "repository", F.filter("assign", lambda s: F.length(s["value"]) >= ASSIGN_VALUE).alias("assign"), "access", "hex",
        tokens.alias("tokens"),
    ).withColumn("base", F.concat("assign", "access", "hex"))
    return base.select(
        F.monotonically_increasing_id().alias("row"), "doc_id", "owner", "repository",
        *[F.size(k).cast("bigint").alias(f"n_{k}") for k in ("assign", "access", "hex")],
        _sorted(F.col("base")).alias("base"), _sorted(F.col("tokens")).alias("tokens"),
    )


def _verdicts(uses: DataFrame) -> DataFrame:
    """For each value its occurrences, distinct repositories and distinct owners."""
    owned = uses.groupBy("hash", "owner").agg(F.count("*").alias("n")).groupBy("hash").agg(
        F.sum("n").alias("n_uses"), F.count("*").alias("n_owners")
    )
    repositories = uses.groupBy("hash", "repository").agg(F.lit(1).alias("one")).groupBy("hash").agg(F.count("*").alias("n_repositories"))
    return owned.join(repositories, "hash")


def secret_spans(
    docs: DataFrame, key: str = "doc_id", text: str = "text", owner: str = "source", repository: str = "doc_id", max_owners: int = MAX_OWNERS,
) -> DataFrame:
    """Base counts and digest, all spans, and how many of them are live or examples, of every row.

    ``live`` lists the spans whose value looks alive and has at most ``max_owners`` owners, with
    the number of repositories and owners; ``n_example`` counts spans and candidates with more.
    """
    found = materialise(_found(docs, key, text, owner, repository), "secrets")
    with_any = found.where(F.size("base") + F.size("tokens") > 0)
    uses = with_any.select(
        "row", "owner", "repository", F.explode(F.concat("base", "tokens")).alias("span"),
    ).select("row", "owner", "repository", "span", F.sha2(F.lower("span.value"), 256).alias("hash"))
    uses, total = materialise_counted(uses, "secret-uses")
    verdicts = materialise(_verdicts(uses), "secret-values")
    hot = F.col("n_uses") * HOT_PART > total
    judged = (
        uses.join(F.broadcast(verdicts.where(hot).select("hash", F.col("n_owners").alias("hot_owners"), F.col("n_repositories").alias("hot_repositories"))), "hash", "left")
        # Rows that have their verdict meet nothing below: a key of their own spreads them.
        .withColumn("asked", F.when(F.col("hot_owners").isNull(), F.col("hash")).otherwise(F.concat(F.lit("-"), F.col("row").cast("string"))))
        .join(verdicts.where(~hot).select(F.col("hash").alias("asked"), "n_owners", "n_repositories"), "asked", "left")
        .select(
            "row", "span", F.coalesce("hot_owners", "n_owners").alias("n_owners"), F.coalesce("hot_repositories", "n_repositories").alias("n_repositories"),
        )
    )
    example = F.col("n_owners") > max_owners
    judged = judged.select("row", "span", "n_owners", "n_repositories", example.alias("example"), (~example & _live_looking(F.col("span.value"))).alias("live"))
    placed = F.struct("span.start", "span.kind", "span.end", "n_repositories", "n_owners")
    kept = (F.col("span.kind") < KINDS.index("owned")) | F.col("live")
    by_row = judged.groupBy("row").agg(
        F.array_sort(F.collect_list(F.when(kept, F.col("span")))).alias("spans"),
        F.array_sort(F.collect_list(F.when(F.col("live"), placed))).alias("live"),
        F.count(F.when(F.col("example"), 1)).alias("n_example"),
    )
    name = F.array(*[F.lit(k) for k in KINDS])
    live = F.transform("live", lambda s: F.struct(
        F.element_at(name, s["kind"] + 1).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["n_repositories"].alias("n_repositories"),
        s["n_owners"].alias("n_owners"),
    ))
    counts = ["doc_id", "n_assign", "n_access", "n_hex"]
    digest = F.sha2(_line(F.col("base")), 256).alias("base_sha256")
    full = with_any.join(by_row, "row").select(
        *counts, digest, _line(F.col("spans")).alias("spans"), F.size("live").cast("bigint").alias("n_live"), "n_example", live.alias("live")
    )
    bare = found.where(F.size("base") + F.size("tokens") == 0).select(
        *counts, digest, F.lit("").alias("spans"), F.lit(0).cast("bigint").alias("n_live"), F.lit(0).cast("bigint").alias("n_example"),
        F.array().cast(full.schema["live"].dataType).alias("live"),
    )
    return full.unionByName(bare)
