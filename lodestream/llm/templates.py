"""Template residue, filler, error pages and script notices in place of real content.

A field is cut into messages: the title, the blocks of shown text and the noscript text of a page, the lines
of a message, the entries of a list. Messages are masked (tokens with digits, hosts and addresses become
``*``) and counted. A prefix tree of fixed depth (number of tokens, then the first two) leads each distinct
message to a leaf. A leaf holds several templates: it is divided (``DIVISIONS`` times) by the token at the place where its
messages differ in the fewest tokens, and in each group a token that most messages share at a place is constant,
the others are wildcards. Leaves and places are aggregated, never collected, so their size doesn't matter. A message
takes its group's template where it agrees with all constants and these are at least ``SIMILAR`` of it; otherwise it
is a template of its own.

Each template is classified once and its verdict goes to all messages it covers, in whatever field they stand:

1. Seeds: phrases of filler, of errors and of script notices. Where a template has mined wildcards, which may stand
   for the very words that decide, its messages are classified by themselves as well, once for all copies.
2. Whole pages: the same set of templates making up the whole of pages of at least ``OWNERS`` unrelated owners is a
   server's page and no content. A template that stands in such pages nearly always (``BOUND``) is a notice, in
   whatever language; a sentence of a shop also stands elsewhere, beside others.
3. Company: filler comes with filler. A template of at least ``OWNERS`` owners is filler if at least ``COMPANY`` of its pages
   have another message that is filler by a seed; for real sentences that share is that of filler pages among all.

Unresolved slots ({{ name }}, %NAME%, <%= name %> and the like) are looked for in every message by itself,
since they stand inside ordinary text.

A page is a case when its title or shown text has a slot or filler, or when it consists of notices: at least
one message is a notice and none is ordinary content. Scripts, styles, comments and attributes don't count;
a noscript text only where nothing else is shown. Messages and list entries are a case when any part is.

Defined results: null and empty fields are never a case; texts of any length are read whole; repeated rows are
each reported; rows of a null owner share an owner; an empty table gives no rows; extra columns are ignored, whatever
their names.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestream.operators.keyed import small_or_shuffled
from lodestream.session import materialize

OWNERS, BOUND, COMPANY, SIMILAR, DIVISIONS = 10, 0.9, 0.5, 0.5, 2
_UNITS = "rec bigint, owner bigint, field string, role string, slot boolean, words int, masked string"
_UNSEEN = re.compile(r"(?is)<!--.*?(?:-->|\Z)|<(script|style|template)\b.*?(?:</\1\s*>|\Z)")
_FRAME = re.compile(r"(?is)<(nav|header|footer)\b.*?(?:</\1\s*>|\Z)")
_TITLE = re.compile(r"(?is)<title\b[^>]*>(.*?)(?:</title\s*>|\Z)")
_NOSCRIPT = re.compile(r"(?is)<noscript\b[^>]*>(.*?)(?:</noscript\s*>|\Z)")
_INLINE = re.compile(r"(?i)</?(?:a|abbr|b|cite|code|em|font|i|mark|small|span|strong|sub|sup|u|wbr)\b[^<>]*>")
_TAG = re.compile(r"<[a-zA-Z/!?][^<>]*>")
_BARE = re.compile(r"[*0\W]*\Z")
_VARYING = re.compile(r"[@/]|\w\.\w")
_HTML = re.compile(r"(?i)<(?:!doctype|html|head|body|title|div|p|h[1-6])\b")

#: The forms of unfilled placeholders.
_SLOTS = [
    r"\{\{-?\s*[\w.$]+",  # {{ name }}, also cut off
    r"\{%-?\s*\w+[^{}]*%\}",  # {% block name %}
    r"[#$]\{[A-Za-z_][\w.]*\}",  # ${name}, #{name}
    r"(?<!\\p)(?<!\\P)\{[A-Za-z_][\w.]*\}",  # {name}
    r"(?<![\w\])}.*+?\\])\{\d*\}",  # {} and {0}, but no quantifier of a regular expression
    r"%\(\w+\)[sd]",  # %(name)s
    r"(?<![\w%])%[sd](?!\w)",  # %s
    r"(?<!\w)%[A-Z][A-Z_]{2,}%(?!\w)",  # %NAME%
    r"\[\[\s*[A-Za-z_][\w.]*\s*\]\]",  # [[name]]
    r"\[(?!SALE\])[A-Z][A-Z_-]{3,}\]",  # [NAME]
    r"(?<!\w)__[A-Z][A-Z_]*__(?!\w)",  # __NAME__
    r"\*\|[A-Z_]+\|\*",  # *|NAME|*
    r"<%=?\s*[\w.]+\s*%>",  # <%= name %>
]
_RAW_SLOT = re.compile("|".join([*_SLOTS, r"<[A-Z][A-Z_]+>", r"&lt;[A-Za-z_][\w.]*&gt;"]))
_SHOWN_SLOT = re.compile("|".join([*_SLOTS, r"<[A-Za-z_][\w.-]*>"]))
#: What every form has one of.
_HINT = re.compile(r"[{%[_*<&]")

#: Seeds, fixed values: phrases of filler, of error pages and of script notices, in lower case, digits as 0.
_FILLER = [
    r"\blorem ipsum\b", r"\bblindtext\b", r"\bplatzhaltertext\b", r"\bbeispiel(?:text|absatz)\b", r"\bplaceholder (?:copy|text|content|paragraph)\b",
    r"\b(?:sample|dummy|example) (?:text|copy|content|paragraph|product (?:one|0))\b", r"\byour (?:own )?(?:text|content|description) (?:goes )?here\b", r"\badd your own (?:description|text|content)\b",
    r"\bclick to edit\b", r"\bdescription to follow\b", r"\bvotre texte ici\b", r"\btexte d.exemple\b", r"\bvoorbeeldtekst\b", r"\bhier komt (?:later )?uw tekst\b",
    r"\bhier (?:steht|kommt) (?:später )?ihr text\b", r"\btext folgt\b", r"(?:\bx{3,}\b\s*){2,}", r"\btesto (?:di esempio|segnaposto)\b", r"\btexto de (?:ejemplo|exemplo|relleno)\b", r"\bexempeltext\b", r"\bprzykładowy tekst\b",
]
_ERROR = [
    r"\b(?:page|seite|página|pagina|strona|sida|ressource|resource|dirección|adresse|address|url)\b.*?(?:\bnot found\b|\bnicht gefunden\b|\bgibt es (?:leider )?nicht\b|\bintrouvable\b|\bno encontrada\b|\bno existe\b|\bniet gevonden\b|\bbestaat niet\b|\bnon trovata\b|\bnão encontrada\b|\bhittades inte\b|\bnie znaleziona\b|\bdoes not exist\b)",
    r"^\W*0+\W+not found\b", r"^\W*(?:error|fehler|erreur) 0+\W*$", r"\bsomething (?:went wrong|broke)\b", r"\bunexpected (?:exception|error) occurred\b", r"\bservice (?:temporarily )?unavailable\b", r"\bserver is overloaded\b",
    r"\bbad gateway\b", r"\bgave no valid answer\b", r"\bgateway time-?out\b", r"\bserver did not answer in time\b", r"\btoo many requests\b", r"\baccess denied\b", r"\b0+ forbidden\b", r"\brequest was blocked by\b",
    r"\bzugriff verweigert\b", r"\bkeine berechtigung\b", r"\baccount suspended\b", r"\bhosting account\b.*?\bswitched off\b", r"\bdomain parked\b", r"\bregistered but has no website\b", r"\bdatabase error\b",
    r"\bestablish(?:ing)? a (?:connection to the )?database\b", r"\bconnection to the database\b", r"(?:^|[:*] )fatal error: ", r"(?:^|[:*] )warning: undefined\b", r"\ballowed memory size of\b", r"\bsitzung (?:ist )?abgelaufen\b", r"\bsession (?:has )?expired\b",
    r"^\W*wartungsarbeiten\W*$", r"\bwird gerade gewartet\b", r"\bin kürze wieder erreichbar\b", r"\b(?:down for|under|scheduled) maintenance\b", r"\ben maintenance\b", r"\bin manutenzione\b", r"\bin onderhoud\b", r"\ben mantenimiento\b", r"\binternal server error\b",
]
_SCRIPT = [
    r"\b(?:enable|activate|allow|turn on) (?:java)?scripts?\b", r"\bneeds (?:java)?scripts? to\b", r"\b(?:java)?scripts? (?:must|has to|have to|needs? to) be (?:switched|turned) on\b", r"\b(?:work|run) without (?:java)?script(?:s|ing)?\b",
    r"\bblocks (?:java)?scripts?\b", r"\b(?:java)?scripts? (?:is|are) (?:required|disabled|switched off)\b", r"\baktivieren sie (?:bitte )?(?:java)?s[ck]ript", r"\bohne (?:java)?s[ck]ripte? kann\b", r"\bbenötigt (?:aktive )?(?:java)?s[ck]ript",
    r"\bactive[rz] (?:le )?(?:java)?script", r"\bactiva(?:r|te)? (?:el )?(?:java)?script", r"\bhabilit[ae]r? (?:o |el )?(?:java)?script", r"\b(?:abilita|attiva)(?:re)? (?:gli |i )?(?:java)?script", r"\bschakel (?:java)?script", r"\bslå på (?:java)?s[ck]ript",
    r"\bative (?:o )?(?:java)?script", r"\bwłącz (?:obsługę )?(?:java)?s[ck]r[iy]pt", r"\b(?:enable|accept|allow|activate) cookies\b", r"\bcookies (?:must be|are) (?:enabled|required|disabled|switched)\b",
]
_CLASSES = {"filler": _FILLER, "error": _ERROR, "script": _SCRIPT}


def shown(text: str) -> dict[str, list[str]]:
    """The title, body and noscript messages of a page, as a reader sees them; navigation, header and footer are no part of it."""
    seen = _UNSEEN.sub("\n", text)
    titles = _TITLE.findall(seen)
    seen = _TITLE.sub("\n", seen)
    hidden = [x for part in _NOSCRIPT.findall(seen) for x in _blocks(part)]
    return {"title": [t for x in titles for t in _blocks(x)], "body": _blocks(_FRAME.sub("\n", _NOSCRIPT.sub("\n", seen))), "noscript": hidden}


def _blocks(part: str) -> list[str]:
    text = _TAG.sub("\n", _INLINE.sub("", part.replace("\n", " ")))
    return [b for line in text.split("\n") if (b := " ".join(html.unescape(line).split()))]


def mask(message: str) -> str:
    """Lower case; tokens with digits, hosts and addresses become ``*``, but plain numbers 0."""
    return " ".join(map(_masked, message.lower().split()))


@lru_cache(maxsize=1 << 16)
def _masked(token: str) -> str:
    if token.isalpha():
        return token
    bare = token.strip(".,;:!?()[]\"'")
    if bare.isdigit():
        return token.replace(bare, "0")
    return "*" if _VARYING.search(bare) or any(c.isdigit() for c in bare) else token


def _parts(field: str, value) -> Iterator[tuple[str, str, bool]]:
    """(role, message, has a slot) of one field's value."""
    if field == "html" or isinstance(value, str) and _HTML.search(value):
        parts = shown(value)
        if any(not _BARE.match(mask(m)) for m in parts["body"]):
            del parts["noscript"]  # it isn't shown where anything else is
        for role, messages in parts.items():
            for m in messages:
                yield role, m, bool(_HINT.search(m) and _SHOWN_SLOT.search(m))
        return
    for entry in value if isinstance(value, list) else [value]:
        if not entry:
            continue
        bare = re.sub(r"^(?:[a-z]+(?:_[a-z]+)*):(?=\S)", "", entry) if isinstance(value, list) else entry
        for line in bare.split("\n"):
            if line.strip():
                yield "message", " ".join(line.split()), bool(_HINT.search(line) and _RAW_SLOT.search(line))


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["rec", "owner", "field", "role", "slot", "words", "masked"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.bool_(), pa.int32(), pa.string()]

    def pack(rows: list[tuple]) -> pa.RecordBatch:
        return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    for b in batches:
        rows: list[tuple] = []
        owners = b.column(1).to_pylist()
        for field, column in zip(b.schema.names[2:], b.columns[2:], strict=True):
            for rec, owner, value in zip(b.column(0).to_pylist(), owners, column.to_pylist(), strict=True):
                if rec is None or not value:
                    continue
                for role, message, slot in dict.fromkeys(_parts(field, value)):
                    masked = mask(message)
                    rows.append((rec, owner, field, role, slot, len(masked.split()), masked))
                if len(rows) > 20_000:
                    yield pack(rows)
                    rows = []
        if rows:
            yield pack(rows)


def units(df: DataFrame, row_id: str, fields: list[str], owner: str | None = None) -> DataFrame:
    """(rec, owner, field, role, slot, words, masked) of every message; parsed once, then kept. Without ``owner`` each record has its own."""
    rec = F.col(row_id).cast("long")
    return materialize(df.select(rec.alias("rec"), (rec if owner is None else F.xxhash64(owner)).alias("owner"), *fields).mapInArrow(_units, _UNITS), "units")


def templates(messages: DataFrame) -> DataFrame:
    """(masked, template) of each distinct message of (masked, n)."""
    t = F.split("masked", " ")
    leaves = messages.select("masked", "n", t.alias("t"), F.xxhash64(F.size(t), F.get(t, F.lit(0)), F.get(t, F.lit(1))).alias("leaf"))
    for _ in range(DIVISIONS):
        # The place that divides a leaf: the fewest tokens, each in two messages or more on average.
        places = leaves.select("leaf", F.posexplode("t").alias("at", "token")).groupBy("leaf", "at", "token").agg(F.count(F.lit(1)).alias("m")).groupBy("leaf", "at").agg(F.count(F.lit(1)).alias("d"), F.sum("m").alias("m"))
        divided = places.where("d > 1 and d * 2 <= m").groupBy("leaf").agg(F.min(F.struct("d", "at")).getField("at").alias("split_at"))
        leaves = leaves.join(divided, "leaf", "left").select("masked", "n", "t", F.when(F.col("split_at").isNull(), F.col("leaf")).otherwise(F.xxhash64("leaf", "split_at", F.expr("get(t, split_at)"))).alias("leaf"))
    spots = leaves.select("leaf", "n", F.posexplode("t").alias("at", "token")).groupBy("leaf", "at", "token").agg(F.sum("n").alias("n"))
    best = spots.groupBy("leaf", "at").agg(F.max(F.struct("n", "token")).alias("top"), F.sum("n").alias("all"))
    constant = F.when(F.col("top.n") * 2 > F.col("all"), F.col("top.token")).otherwise("*")
    # A leaf has as many places as its messages have tokens, so this list is as long as one message.
    of = best.groupBy("leaf").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", constant.alias("token")))), lambda x: x["token"]).alias("pattern"))
    both = leaves.join(of, "leaf")
    fits = F.forall(F.arrays_zip("t", "pattern"), lambda x: (x["pattern"] == "*") | (x["pattern"] == x["t"]))
    specific = F.size(F.filter("pattern", lambda x: x != "*")) >= F.size("pattern") * SIMILAR
    return both.select("masked", F.when(fits & specific, F.array_join("pattern", " ")).otherwise(F.col("masked")).alias("template"))


def _kind(column: str) -> Column:
    """The first class that a text has a phrase of."""
    return F.coalesce(*(F.when(F.col(column).rlike("|".join(p)), F.lit(name)) for name, p in _CLASSES.items()))


def labelled(messages: DataFrame, mine=templates) -> DataFrame:
    """(masked, template, filler, error, script): each distinct message with its template and what the seeds say of either."""
    of = mine(messages)
    once = of.select("template").distinct().select("template", _kind("template").alias("kind"))
    own = F.when(F.col("masked") != F.col("template"), _kind("masked"))
    both = of.join(once, "template").select("masked", "template", F.array("kind", own).alias("kinds"))
    return both.select("masked", "template", *(F.coalesce(F.array_contains(F.array_compact("kinds"), k), F.lit(False)).alias(k) for k in _CLASSES))


def verdicts(messages: DataFrame) -> DataFrame:
    """(masked, verdict) of the messages that the seeds find to be filler, an error or a script notice, by their template or by themselves; a row for each."""
    found = F.array_compact(F.array(*(F.when(F.col(k), F.lit(k)) for k in _CLASSES)))
    return labelled(messages).select("masked", F.explode(found).alias("verdict"))


def evidence(judged: DataFrame, pages: DataFrame) -> DataFrame:
    """(template, mined_filler, mined_notice): what the corpus shows of templates that no seed judges.

    Owners are counted by sketches of fixed size, which are exact for so few.
    """
    signed = pages.where("signature is not null")
    known = small_or_shuffled(signed.groupBy("signature").agg(F.approx_count_distinct("owner").alias("owners")).where(F.col("owners") >= OWNERS).select("signature", F.lit(True).alias("recurs")))
    marked = signed.join(known, "signature", "left").where("recurs or has_filler").select("rec", "field", "owner", F.coalesce("recurs", F.lit(False)).alias("recurs"), "has_filler")
    whole = judged.where(F.col("unjudged") & F.col("role").isin("body", "noscript")).select("rec", "field", "template")
    of = whole.join(small_or_shuffled(marked), ["rec", "field"]).groupBy("template").agg(F.count_if("recurs").alias("recur"), F.count_if("has_filler").alias("filled"), F.approx_count_distinct("owner").alias("owners"))
    of = small_or_shuffled(of.where(F.col("owners") >= OWNERS))
    n = whole.join(of.select("template"), "template", "left_semi").groupBy("template").agg(F.count(F.lit(1)).alias("n"))
    return n.join(of, "template").select("template", (F.col("filled") >= F.col("n") * COMPANY).alias("mined_filler"), (F.col("recur") >= F.col("n") * BOUND).alias("mined_notice")).where("mined_filler or mined_notice")


def residue(df: DataFrame, row_id: str, fields: list[str], owner: str | None = None, mine=templates) -> DataFrame:
    """(rec, field, reasons): the records and fields that hold residue instead of content.

    ``owner`` names the column that tells unrelated records apart, such as their host.
    """
    seen = units(df, row_id, fields, owner)
    messages = materialize(seen.groupBy("masked").agg(F.count(F.lit(1)).alias("n")), "messages")
    plain, notice = ~F.col("masked").rlike(r"^[*0\W]*$"), F.col("error") | F.col("script")
    labels = labelled(messages, mine).select("masked", F.xxhash64("template").alias("template"), "filler", "script", notice.alias("notice"), plain.alias("plain"))
    judged = seen.join(small_or_shuffled(labels.withColumn("unjudged", F.expr("plain and not filler and not notice"))), "masked").drop("masked")
    page, message, body = F.col("role").isin("title", "body"), F.col("role") == "message", F.col("role") == "body"
    shown_ = F.col("plain") & F.col("role").isin("body", "noscript")
    pages = judged.groupBy("rec", "field").agg(
        F.min("owner").alias("owner"),
        F.max(F.col("slot") & (page | message)).alias("slot"),
        F.max(F.col("filler") & (page | message)).alias("has_filler"),
        F.max(F.col("notice") & body).alias("body_notice"),
        F.max(F.col("script") & (F.col("role") == "noscript")).alias("hidden_notice"),
        F.max(F.col("notice") & message).alias("message_notice"),
        F.sum(F.when(F.col("unjudged") & body, F.col("words")).otherwise(0)).alias("content"),
        F.bit_xor(F.when(shown_, F.col("template"))).alias("_xor"), F.count_if(shown_).alias("_n"),
    )
    # The templates that make up a page, in whatever order.
    pages = materialize(pages.select("*", F.when(F.col("_n") > 0, F.xxhash64("_xor", "_n")).alias("signature")).drop("_xor", "_n"), "pages")
    mined = small_or_shuffled(evidence(judged, pages))
    more = judged.where("unjudged").join(mined, "template").groupBy("rec", "field").agg(
        F.max(F.col("mined_filler") & (page | message)).alias("more_filler"),
        F.max(F.col("mined_notice") & F.col("role").isin("body", "noscript")).alias("more_shown"),
        F.max(F.col("mined_notice") & message).alias("more_message"),
        F.sum(F.when(body, F.col("words")).otherwise(0)).alias("less"),
    )
    by = pages.join(more, ["rec", "field"], "left").na.fill(False).na.fill(0, ["less"])
    consists = (F.col("content") == F.col("less")) & (F.col("body_notice") | F.col("hidden_notice") | F.col("more_shown"))
    reasons = {"slot": F.col("slot"), "filler": F.col("has_filler") | F.col("more_filler"), "notice": consists | F.col("message_notice") | F.col("more_message")}
    found = F.array_compact(F.array(*(F.when(c, F.lit(n)) for n, c in reasons.items())))
    return by.select("rec", "field", found.alias("reasons")).where(F.size("reasons") > 0)
