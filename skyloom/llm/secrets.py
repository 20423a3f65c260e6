"""Secret scans in DataFrame operations only, judged by corpus-wide ownership.

Candidates are found in every whole text with their places.  Their values are
hashed and counted by distinct repositories and owners over the whole corpus: a
value that many owners share, or that two spread over many repositories, is a
copied example; one that stays with few owners looks live, in however many
repositories one owner keeps it.  Base candidates are always reported; candidates
of the wider patterns are reported only if they look live.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import durable

# The base patterns.
ASSIGN = r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"(AKIA[A-Z0-9]{16,})"
HEX = r"([0-9a-f]{24,})"
#: What the method adds: provider tokens, private-key blocks, signed tokens; and long runs of letters of both cases with digits.
PROVIDER = r"(gh[oprsu]_[A-Za-z0-9]{30,}|xox[abprs]-[A-Za-z0-9-]{16,}|AIza[A-Za-z0-9_-]{30,}|-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----|eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+)"
LONG = r"((?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{36,})"
KINDS = ("assign", "access", "hex", "key")
#: Distinct owners from which on a value is a copied example; and repositories from which on it is one with two owners.
EXAMPLE_OWNERS, EXAMPLE_REPOSITORIES = 3, 6

_SPANS = "array<struct<start:long,kind:int,end:long,value:string>>"


def let(value: Column, use) -> Column:
    """``use`` of a value that is evaluated once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def running(values: Column, op) -> Column:
    """The running ``op`` (a sum or a maximum, say) of an array of longs.

    The array is folded in parts of the root of its size, then the parts' ends are
    folded, so a text with very many hits does not copy its array for each of them.
    """
    none = F.array().cast("array<long>")
    last = lambda a: F.element_at(a, -1)

    def fold(part: Column) -> Column:
        return F.aggregate(part, none, lambda acc, x: F.concat(acc, F.array(F.when(F.size(acc) > 0, op(last(acc), x)).otherwise(x))))

    def over(x: Column) -> Column:
        step = F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(x["v"]))).cast("int"))
        parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(x["v"]) - 1) / step).cast("int")), lambda k: fold(F.slice(x["v"], k * step + 1, step)))
        whole = lambda y: F.flatten(F.transform(y["p"], lambda part, k: F.transform(part, lambda z: F.when(k > 0, op(F.get(y["e"], k - 1), z)).otherwise(z))))
        return let(parts, lambda p: let(F.struct(p.alias("p"), fold(F.transform(p, last)).alias("e")), whole))

    return let(F.struct(values.cast("array<long>").alias("v")), lambda x: F.when(F.size(x["v"]) > 0, over(x)).otherwise(none))


def _found(text: Column, pattern: str, kind: int, likely: Column, least: int = 0) -> Column:
    """struct<spans, mask> of the leftmost non-overlapping matches whose value has ``least`` characters.

    The pieces between matches and the matches themselves alternate, so the running
    sum of their lengths is the places.  The mask has a byte for each character up to
    the last match, 1 in a span.
    """

    def places(x: Column) -> Column:
        size = lambda i: F.length(F.get(x["gaps"], i))
        ends = running(F.transform(x["hits"], lambda h, i: size(i) + F.length(h)), lambda a, b: a + b)
        spans = let(ends, lambda e: F.transform(x["hits"], lambda h, i: F.struct((F.get(e, i) - F.length(h)).alias("start"), F.lit(kind).alias("kind"), F.get(e, i).alias("end"), F.regexp_extract(h, pattern, 1).alias("value"))))
        mask = F.array_join(F.transform(x["hits"], lambda h, i: F.concat(F.repeat(F.lit("0"), size(i)), F.repeat(F.when(F.length(F.regexp_extract(h, pattern, 1)) >= least, "1").otherwise("0"), F.length(h)))), "")
        return F.struct(F.filter(spans.cast(_SPANS), lambda s: F.length(s["value"]) >= least).alias("spans"), mask.cast("binary").alias("mask"))

    none = F.struct(F.array().cast(_SPANS).alias("spans"), F.lit("").cast("binary").alias("mask"))
    pair = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hits"), F.split(text, pattern, -1).alias("gaps"))
    return F.when(likely, let(pair, lambda x: F.when(F.size(x["hits"]) > 0, places(x)).otherwise(none))).otherwise(none)


def candidates(text: Column) -> Column:
    """All candidate spans of a text, base and wider, in order of start and kind; a wider one that meets a base one is left out."""
    body = F.coalesce(text, F.lit(""))
    low = F.lower(body)
    found = F.struct(
        _found(body, ASSIGN, 0, low.contains("passw") | low.contains("secret") | low.contains("token") | low.contains("apikey") | low.contains("api_key"), 6).alias("assign"),
        _found(body, ACCESS, 1, body.contains("AKIA")).alias("access"),
        _found(body, HEX, 2, body.rlike("[0-9a-f]{24}")).alias("hex"),
        _found(body, PROVIDER, 3, body.rlike(r"gh[oprsu]_|xox[abprs]-|AIza|-----BEGIN|eyJ")).alias("provider"),
        _found(body, LONG, 3, body.rlike(r"[A-Za-z0-9+/_-]{36}")).alias("long"),
    )

    def joined(x: Column) -> Column:
        free = lambda s, names: ~F.lit(False) if not names else ~(F.substring(x[names[0]]["mask"], (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")).cast("string").contains("1")) & free(s, names[1:])
        mixed = lambda s: s["value"].rlike("[0-9]") & s["value"].rlike("[A-Z]") & s["value"].rlike("[a-z]")
        base = ("assign", "access", "hex")
        provider = F.filter(x["provider"]["spans"], lambda s: free(s, base))
        long = F.filter(x["long"]["spans"], lambda s: mixed(s) & free(s, (*base, "provider")))
        return F.array_sort(F.concat(*[x[name]["spans"] for name in base], provider, long))

    return let(found, joined)


def ownership(found: DataFrame) -> DataFrame:
    """(code, repositories, owners) of every candidate hash in ``found`` (code, repository, owner), over the whole corpus."""
    pairs = found.groupBy("code", "owner", "repository").agg(F.lit(1).alias("one"))
    by_owner = pairs.groupBy("code", "owner").agg(F.count("*").alias("n"))
    return by_owner.groupBy("code").agg(F.sum("n").alias("repositories"), F.count("*").alias("owners"))


def is_live(owners: Column, repositories: Column) -> Column:
    """Whether a value looks like its owner's own: one owner keeps it in any number of repositories, two in a few at most."""
    return (owners == 1) | (owners < EXAMPLE_OWNERS) & (repositories < EXAMPLE_REPOSITORIES)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner: Column | None = None, repository: Column | None = None, keep: bool = False) -> DataFrame:
    """One row per row of ``docs``: its id and ``spans``, array<struct<start, kind, end, live>>.

    kind indexes ``KINDS``; places are code points, the end exclusive.  live says that
    fewer than ``EXAMPLE_OWNERS`` distinct owners have the value, and no two of them in
    ``EXAMPLE_REPOSITORIES`` repositories or more.  Owner and repository default to the
    source and to source with language; nulls count as one owner, or one repository of
    their owner.  Null and empty texts have no spans, repeated rows each keep their own, an empty table
    gives an empty result.  With ``keep`` the whole row comes along as a struct, ``doc``.
    """
    doc = [F.struct(*docs.columns).alias("doc")] if keep else []
    owner = F.coalesce((F.col("source") if owner is None else owner).cast("string"), F.lit(""))
    repository = F.coalesce((F.concat_ws("/", "source", "lang") if repository is None else repository).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), owner.alias("owner"), repository.alias("repository"), candidates(F.col(text_col).cast("string")).alias("found"), *doc)
    hashed = F.transform("found", lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end"), F.sha2(x["value"], 256).alias("code")))
    rows = durable(rows.select(F.monotonically_increasing_id().alias("row"), "id", "owner", "repository", hashed.alias("found"), *["doc"] * keep), "candidates")
    each = rows.select("row", "owner", "repository", F.explode("found").alias("x")).select("row", "owner", "repository", "x.*")
    judged = each.join(ownership(each.select("code", "owner", "repository")), "code")
    span = F.struct("start", "kind", "end", is_live(F.col("owners"), F.col("repositories")).alias("live"))
    spans = judged.groupBy("row").agg(F.array_sort(F.collect_list(span)).alias("spans"))
    none = F.array().cast("array<struct<start:long,kind:int,end:long,live:boolean>>")
    rows = rows.select("row", "id", *["doc"] * keep).join(spans, "row", "left")
    return rows.select(F.col("id").alias(id_col), F.coalesce("spans", none).alias("spans"), *["doc"] * keep)


def reported(spans: Column) -> Column:
    """The spans that count as secrets: the base ones, and wider ones that look live."""
    return F.filter(spans, lambda x: (x["kind"] < 3) | x["live"])


def report(scanned: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The digest of :func:`scan`: counts by base kind, hash of the base spans, all reported spans."""
    base = F.filter("spans", lambda x: x["kind"] < 3)
    shown = reported(F.col("spans"))
    names = F.array(*map(F.lit, KINDS))
    text = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"].cast("string"), x["end"].cast("string"))), ",")
    of = lambda k: F.size(F.filter("spans", lambda x: x["kind"] == k)).cast("long")
    return scanned.select(
        id_col, of(0).alias("n_assign"), of(1).alias("n_access"), of(2).alias("n_hex"),
        F.sha2(text(base), 256).alias("base_sha256"), text(shown).alias("spans"),
        F.size(F.filter(shown, lambda x: x["live"])).cast("long").alias("n_live"),
    )


def redacted(text: Column, spans: Column, mark: str = "[secret]") -> Column:
    """The text with each of the sorted spans replaced by ``mark``; spans that overlap give one mark.

    The pieces between the spans are cut from a form with four bytes for each
    character, so that a place is found at once.
    """
    wide = F.encode(text, "UTF-32")
    cut = lambda raw, a, b: F.decode(F.substring(raw, (4 * a + 1).cast("int"), F.greatest(F.lit(0), (4 * (b - a)).cast("int"))), "UTF-32")

    def parts(x: Column) -> Column:
        before = lambda i: F.when(i > 0, F.get(x["ends"], i - 1)).otherwise(F.lit(0).cast("long"))
        pieces = F.transform(x["spans"], lambda s, i: F.when(s["start"] >= before(i), F.concat(cut(x["raw"], before(i), s["start"]), F.lit(mark))).otherwise(""))
        return F.concat(F.array_join(pieces, ""), cut(x["raw"], F.element_at(x["ends"], -1), F.octet_length(x["raw"]) / 4))

    ends = running(F.transform(spans, lambda s: s["end"]), lambda a, b: F.greatest(a, b))
    return F.when(F.size(spans) > 0, let(F.struct(spans.alias("spans"), ends.alias("ends"), wide.alias("raw")), parts)).otherwise(text)
