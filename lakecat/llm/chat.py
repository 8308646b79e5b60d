r"""Chat formatting in Spark expressions only.

The turn structs of a conversation are collected and sorted; adjacent turns of one role become one run; runs are concatenated:

    <|im_start|>role<|im_text|>text<|im_sep|>text of the next turn of that role<|im_end|>\n

Inside roles and texts a backslash is doubled and each control string (CONTROL) gets a backslash after its first character, so
none is left; removing each backslash and keeping what follows it restores the text.

`segments` is the formatted text cut at the borders of the loss mask and `loss` says which segments bear loss: one segment
for each text of the trained role, none of the marks. Joined, the segments are the formatted text.

Defined results: turns are ordered by turn, then role, then text, nulls first; a null role or text counts as empty; repeated
rows are turns of their own; rows with a null conv_id form one conversation; a conversation without the trained role has
no loss; an empty table gives an empty result; extra columns are left out. Texts of any length are formatted whole; a conversation
is one row of the output, so all its turns have to fit one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

START, TEXT, SEP, END = "<|im_start|>", "<|im_text|>", "<|im_sep|>", "<|im_end|>\n"
TRAINED = "assistant"
#: Strings that chat models and tokenizers read as control strings (any name between <| and |>), without their first
#: character; as a regular expression.
CONTROL = r"\|[A-Za-z0-9_]+\|>|/?s>|/?INST\]|</?SYS>>"


def escape(text: Column) -> Column:
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), rf"([<\[])(?={CONTROL})", r"$1\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _quoted(mark: str) -> str:
    return mark.replace("|", r"\|")


def formatted(conversations: DataFrame, trained: str = TRAINED) -> DataFrame:
    """conv_id, `segments` and `loss`."""
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), escape(F.coalesce("text", F.lit(""))).alias("text"))
    # the order is that of the texts themselves, which escaping may change
    order = F.struct(F.col("turn").alias("n"), F.col("role").alias("r"), F.col("text").alias("t"))
    turns = conversations.groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list(F.struct(order.alias("order"), turn.alias("own")))), lambda x: x["own"]).alias("turns"))
    starts = turns.withColumn("starts", F.filter(F.sequence(F.lit(0), F.size("turns") - 1), lambda i: (i == 0) | (F.get("turns", i)["role"] != F.get("turns", i - 1)["role"])))
    runs = starts.withColumn(
        "runs",
        F.transform(
            "starts",
            lambda s, j: F.struct(
                F.get("turns", s)["role"].alias("role"),
                F.transform(F.slice("turns", s + 1, F.coalesce(F.get("starts", j + 1), F.size("turns")) - s), lambda t: t["text"]).alias("texts"),
            ),
        ),
    )
    piece = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
    no = F.lit(False)
    whole = runs.withColumn(
        "pieces",
        F.flatten(
            F.transform(
                "runs",
                lambda r: F.concat(
                    F.flatten(
                        F.transform(
                            r["texts"],
                            lambda t, j: F.array(
                                piece(F.when(j == 0, F.concat(F.lit(START), escape(r["role"]), F.lit(TEXT))).otherwise(F.lit(SEP)), no),
                                piece(t, r["role"] == trained),
                            ),
                        )
                    ),
                    F.array(piece(F.lit(END), no)),
                ),
            )
        ),
    )
    return whole.select("conv_id", F.col("pieces.text").alias("segments"), F.col("pieces.loss").alias("loss"))


def read_back(output: DataFrame) -> DataFrame:
    """conv_id, `turns` (array of role, text), `trained` (text under the mask) and `formatted`, from the output alone."""
    text = output.withColumn("formatted", F.array_join("segments", ""))
    blocks = F.filter(F.split("formatted", _quoted(END)), lambda b: b != "")

    def turns(block: Column) -> Column:
        parts = F.split(F.substr(block, F.lit(len(START) + 1)), _quoted(TEXT), 2)
        return F.transform(F.split(F.get(parts, F.lit(1)), _quoted(SEP), -1), lambda t: F.struct(unescape(F.get(parts, F.lit(0))).alias("role"), unescape(t).alias("text")))

    under = F.array_join(F.transform(F.filter(F.arrays_zip("segments", "loss"), lambda s: s["loss"]), lambda s: unescape(s["segments"])), "")
    return text.select("conv_id", F.flatten(F.transform(blocks, turns)).alias("turns"), under.alias("trained"), "formatted")


def digests(conversations: DataFrame) -> DataFrame:
    back = read_back(formatted(conversations))
    joined = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(joined, 256).alias("turns_sha256"),
        F.length("trained").cast("long").alias("loss_chars"),
        F.sha2("trained", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    probe = "</s>[INST] ok [/INST]"
    rows = common.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    own = spark.sql(f"SELECT * FROM VALUES (-1L, 0L, 'user', '{probe}'), (-1L, 1L, 'assistant', '{probe}') AS t(conv_id, turn, role, text)")
    return digests(rows.unionByName(own))


SQL = r"""
WITH rows_ AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, text AS t, role AS r FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]', '</s>[INST] ok [/INST]', 'user'),
                   (-1, 1, 'assistant', '</s>[INST] ok [/INST]', '</s>[INST] ok [/INST]', 'assistant')
), seen AS (
  SELECT *, row_number() OVER w AS n, lag(role) OVER w AS before,
         length(regexp_replace(replace(text, '\', '\\'), '([<\[])(\|[A-Za-z0-9_]+\|>|/?s>|/?INST\]|</?SYS>>)', '\1\\\2', 'g')) AS own
  FROM rows_ WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, r NULLS FIRST, t NULLS FIRST)
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY n)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY n) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(own + CASE WHEN before IS NOT DISTINCT FROM role AND n > 1 THEN 10 ELSE 12 + 11 + 11 + length(role) END)::BIGINT AS formatted_chars
FROM seen GROUP BY conv_id
"""
