"""Chat formatting of typed content parts, with DataFrame functions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Template marks and the control strings escaped inside texts (fixed values): <| opens every mark of ours;
#: <s> </s> [INST] [/INST] <<SYS>> <</SYS>> belong to other common templates.
TURN, BODY, END = "<|turn|>", "<|body|>", "<|end|>"
CONTROL = r"(\||/?s>|/?INST\]|<SYS>>|</SYS>>)"
PART_SCHEMA = "array<struct<type:string,text:string,ref:string,units:bigint>>"
#: Tokens that stand for one unit of an attachment: an image tile, a second of audio, a page of a document.
TOKENS_PER_UNIT = {"image": 256, "audio": 25, "document": 512}


def escape(text: Column) -> Column:
    """Puts one more backslash after the first character of each control string, whatever backslashes it already has there."""
    return F.regexp_replace(text, r"([<\[])(\\*)" + CONTROL, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    """Undoes escape()."""
    return F.regexp_replace(text, r"([<\[])\\(\\*)" + CONTROL, "$1$2$3")


def _visit(part: Column) -> Column:
    """Text of one part: escaped text, or a placeholder that names kind, reference and expanded tokens."""
    kind = F.coalesce(part["type"], F.lit("text"))
    known = kind.isin(*TOKENS_PER_UNIT)
    placeholder = F.concat(F.lit("<|"), kind, F.lit(" "), escape(F.coalesce(part["ref"], F.lit(""))), F.lit(" "), _tokens(part).cast("string"), F.lit("|>"))
    return F.when(known, placeholder).otherwise(escape(F.coalesce(part["text"], F.lit(""))))


def _tokens(part: Column) -> Column:
    out = F.lit(0)
    for kind, n in TOKENS_PER_UNIT.items():
        out = F.when(part["type"] == kind, F.greatest(F.coalesce(part["units"], F.lit(1)), F.lit(1)) * n).otherwise(out)
    return out.cast("long")


def text_parts(text: Column) -> Column:
    """A plain text column as a list of one text part."""
    return F.array(F.struct(F.lit("text").alias("type"), text.alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("bigint").alias("units")))


def format_chats(turns: DataFrame, trained_role: str = "assistant") -> DataFrame:
    """Formats conversations given as rows (conv_id, turn, role, parts), parts as PART_SCHEMA.

    Returns per conv_id: formatted, segments (per turn: body_start, the code points from the turn's mark to its body, body_length, and loss, whether it is
    under the loss mask), attachments (turn order: kind, ref, tokens) and expanded_tokens.

    Null role, text or parts: empty. Unknown part types: their text. Null turn: first. Null conv_id: a conversation of its own. Equal turns: by role, then
    text. Repeated rows: repeated turns. Empty table: no rows. Other columns are not read.
    One conversation becomes one row, so its turns meet in one task; conversations are spread by conv_id.
    """
    parts = F.coalesce(F.col("parts").cast(PART_SCHEMA), F.array().cast(PART_SCHEMA))
    one = turns.select(
        "conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"),
        F.concat_ws("", F.transform(parts, _visit)).alias("body"),
        F.transform(F.filter(parts, lambda p: p["type"].isin(*TOKENS_PER_UNIT)), lambda p: F.struct(p["type"].alias("kind"), p["ref"].alias("ref"), _tokens(p).alias("tokens"))).alias("attached"),
    )
    head = F.concat(F.lit(TURN), escape(F.col("role")), F.lit(BODY))
    one = one.select("conv_id", F.struct("turn", "role", "body", head.alias("head"), F.length(head).cast("long").alias("head_length"), F.length("body").cast("long").alias("body_length"), "attached").alias("t"))
    chats = one.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("ts"))
    # Starts are the running sum of whole turns; the sum is kept in one struct, so a chat of n turns costs n steps, not a list copied n times.
    whole = lambda t: F.concat(t["head"], t["body"], F.lit(END))
    chats = chats.select(
        "conv_id", "ts", F.concat_ws("", F.transform("ts", whole)).alias("formatted"),
        F.transform("ts", lambda t: F.struct(t["head_length"].alias("body_start"), t["body_length"].alias("body_length"), (t["role"] == trained_role).alias("loss"))).alias("segments"),
        F.flatten(F.transform("ts", lambda t: t["attached"])).alias("attachments"),
    )
    tokens = F.aggregate("attachments", F.lit(0).cast("long"), lambda n, a: n + a["tokens"])
    return chats.select("conv_id", "formatted", "segments", "attachments", tokens.alias("expanded_tokens"))


def read_chats(chats: DataFrame) -> DataFrame:
    """Reads format_chats() rows back: conv_id, formatted and turns (role, text, loss_text), taken from the formatted text and its segments alone.

    segments are relative to their turn: body_start and body_length count code points from the turn's mark.
    """
    pieces = F.filter(F.split("formatted", r"<\|turn\|>"), lambda _, i: i > 0)  # nothing stands before the first mark
    mark = len(TURN)

    def turn(piece: Column, segment: Column) -> Column:
        role = F.substring_index(piece, BODY, 1)
        under = F.substring(piece, (segment["body_start"] - mark + 1).cast("int"), segment["body_length"].cast("int"))
        # A trailing END is the turn's own; those inside its text are escaped.
        body = F.substring_index(F.substring_index(piece, BODY, -1), END, 1)
        return F.struct(unescape(role).alias("role"), unescape(body).alias("text"), F.when(segment["loss"], unescape(under)).alias("loss_text"))

    return chats.select("conv_id", "formatted", F.zip_with(pieces, "segments", turn).alias("turns"))


def op2_chat_format(spark, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    probe = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(probe).alias("text"))
    chats = format_chats(rows.unionByName(extra).select("conv_id", "turn", "role", text_parts(F.col("text")).alias("parts")))
    back = read_chats(chats)
    flat = F.concat_ws("", F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))))
    loss = F.concat_ws("", F.transform("turns", lambda t: t["loss_text"]))
    back = back.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(flat.cast("binary"), 256).alias("turns_sha256"), loss.alias("loss"), F.length("formatted").cast("long").alias("formatted_chars"))
    return back.select("conv_id", "n_turns", "turns_sha256", F.length("loss").cast("long").alias("loss_chars"), F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"), "formatted_chars")


OP2_SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
forms AS (SELECT *, length(regexp_replace(role, '([<\[])(\\*)(\||/?s>|/?INST\]|<SYS>>|</SYS>>)', '\1\\\2\3', 'g'))
  + length(regexp_replace(text, '([<\[])(\\*)(\||/?s>|/?INST\]|<SYS>>|</SYS>>)', '\1\\\2\3', 'g')) + 23 AS chars FROM rows)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM forms GROUP BY conv_id
"""
