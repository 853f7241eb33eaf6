"""YAML text of note headers as expressions: scalar styles, escapes and folding at 80 columns.

Texts are written plain where that reads back as the same text, else in single quotes, else in
double quotes with escapes. Lines fold at single spaces once they are longer than the width;
continuation lines are indented by two. The result is what the usual Python writer gives for
block style, Unicode allowed and keys in the given order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

from marginalia.functions.planning import let

WIDTH = 80
INDENT = "  "
_BREAK = r"\n\x{85}\x{2028}\x{2029}"

# Plain texts that YAML 1.1 reads as something else than text.
_OTHER_TYPES = "|".join(
    [
        "yes|Yes|YES|no|No|NO|true|True|TRUE|false|False|FALSE|on|On|ON|off|Off|OFF",
        "~|null|Null|NULL|",
        "<<|=",
        "[-+]?0b[0-1_]+|[-+]?0[0-7_]+|[-+]?(?:0|[1-9][0-9_]*)|[-+]?0x[0-9a-fA-F_]+|[-+]?[1-9][0-9_]*(?::[0-5]?[0-9])+",
        r"[-+]?[0-9][0-9_]*\.[0-9_]*(?:[eE][-+][0-9]+)?|\.[0-9][0-9_]*(?:[eE][-+][0-9]+)?",
        r"[-+]?[0-9][0-9_]*(?::[0-5]?[0-9])+\.[0-9_]*|[-+]?\.(?:inf|Inf|INF)|\.(?:nan|NaN|NAN)",
        r"[0-9]{4}-[0-9]{2}-[0-9]{2}",
        r"[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}(?:[Tt]|[ \t]+)[0-9]{1,2}:[0-9]{2}:[0-9]{2}(?:\.[0-9]*)?"
        r"(?:[ \t]*(?:Z|[-+][0-9]{1,2}(?::[0-9]{2})?))?",
    ]
)
# Characters that only double quotes can hold, those that are escaped there, and their short escapes.
_SPECIAL = r"[^\n\x20-\x7e\x{85}\x{a0}-\x{d7ff}\x{e000}-\x{fefe}\x{ff00}-\x{fffd}\x{10000}-\x{10fffe}]"
_ESCAPED = r"[^\x20-\x7e\x{a0}-\x{d7ff}\x{e000}-\x{fffd}]|[\"\\\x{2028}\x{2029}\x{feff}]"
_SHORT_ESCAPES = {
    "\0": "0", "\x07": "a", "\x08": "b", "\x09": "t", "\x0a": "n", "\x0b": "v", "\x0c": "f", "\x0d": "r", "\x1b": "e",
    '"': '"', "\\": "\\", "\x85": "N", "\u2028": "L", "\u2029": "P",
}
# A plain text may not begin like another kind of node, nor hold what ends a key or begins a comment.
_INDICATORS = r"""^(?:---|\.\.\.|[#,\[\]{}&*!|>'"%@`]|[?\-:](?: |\z))|:(?: |\z)| #"""

PLAIN, SINGLE, DOUBLE = "plain", "single", "double"


def style(text: Column) -> Column:
    """How a text is written."""
    special = F.rlike(text, F.lit(_SPECIAL))
    torn = F.rlike(text, F.lit(rf" [{_BREAK}]|[{_BREAK}] "))
    unsafe = (
        F.rlike(text, F.lit(rf"[{_BREAK}]|^ | \z"))
        | F.rlike(text, F.lit(_INDICATORS))
        | F.rlike(text, F.lit(rf"\A(?:{_OTHER_TYPES})\z"))
    )
    return F.when(special | torn, DOUBLE).when(unsafe, SINGLE).otherwise(PLAIN)


def _state(done: Column, line: Column, column: Column) -> Column:
    return F.struct(done.alias("done"), line.alias("line"), column.cast("int").alias("column"))


def _start(column: Column) -> Column:
    return _state(F.array().cast("array<string>"), F.lit(""), column)


def _ended(state: Column) -> Column:
    return F.concat(F.array_join(state["done"], ""), state["line"])


def _folded(text: Column, column: Column) -> Column:
    """Words, runs of spaces and line breaks, one after the other; `column` is where the text begins."""
    tokens = F.regexp_extract_all(text, F.lit(rf"( +|[{_BREAK}]+|[^ {_BREAK}]+)"), 1)

    def folded(all_tokens: Column) -> Column:
        numbered = F.transform(all_tokens, lambda token, at: F.struct(token.alias("t"), at.alias("at")))
        last = F.size(all_tokens) - 1

        def put(state: Column, item: Column) -> Column:
            token = item["t"]
            fold = (token == " ") & (state["column"] > WIDTH) & (item["at"] > 0) & (item["at"] < last)
            broken = F.rlike(token, F.lit(f"^[{_BREAK}]"))
            # A line break is written twice, so that it is not read as a fold.
            run = F.concat(F.when(F.startswith(token, F.lit("\n")), F.lit("\n")).otherwise(""), token)
            end = F.when(fold, F.lit("\n")).otherwise(run)
            return F.when(
                fold | broken, _state(F.concat(state["done"], F.array(F.concat(state["line"], end))), F.lit(INDENT), F.lit(len(INDENT)))
            ).otherwise(_state(state["done"], F.concat(state["line"], token), state["column"] + F.length(token)))

        return F.aggregate(numbered, _start(column), put, _ended)

    return let(tokens, folded)


def _escape(char: Column) -> Column:
    code = F.hex(F.encode(char, "UTF-32"))
    short = F.create_map(*(F.lit(x) for pair in _SHORT_ESCAPES.items() for x in pair))
    return F.coalesce(
        F.concat(F.lit("\\"), short[char]),
        F.when(F.startswith(code, F.lit("000000")), F.concat(F.lit("\\x"), F.right(code, F.lit(2))))
        .when(F.startswith(code, F.lit("0000")), F.concat(F.lit("\\u"), F.right(code, F.lit(4))))
        .otherwise(F.concat(F.lit("\\U"), code)),
    )


def _double_folded(text: Column, column: Column) -> Column:
    """Characters one after the other; `held` are those since the last possible fold."""
    chars = F.split(text, "")

    def folded(each: Column) -> Column:
        count = F.size(each)
        items = F.transform(
            each,
            lambda c, at: F.struct(
                c.alias("c"), at.alias("at"), F.coalesce(F.get(each, at + 1), F.lit("")).alias("next"),
                F.when(F.rlike(c, F.lit(_ESCAPED)), _escape(c)).alias("escape"),
            ),
        )
        start = F.struct(_start(column).alias("s"), F.lit("").alias("held"))

        def put(state: Column, item: Column) -> Column:
            s, escaped = state["s"], item["escape"].isNotNull()
            added = F.when(escaped, F.concat(state["held"], item["escape"])).otherwise("")
            line, at = F.concat(s["line"], added), s["column"] + F.length(added)
            held = F.when(escaped, F.lit("")).otherwise(state["held"])
            # Right after an escape the next character is not yet there.
            length = F.when(escaped, F.lit(-1)).otherwise(F.length(held))
            inside = (item["at"] > 0) & (item["at"] < count - 1)
            fold = inside & ((item["c"] == " ") | (held == "")) & (at + length > WIDTH)
            ahead = F.when(escaped, item["next"]).otherwise(item["c"])
            # A line cannot begin with a space that counts unless it is escaped.
            begin = F.concat(F.lit(INDENT), F.when(ahead == " ", F.lit("\\")).otherwise(""))
            new = F.when(
                fold, _state(F.concat(s["done"], F.array(F.concat(line, held, F.lit("\\\n")))), begin, F.length(begin))
            ).otherwise(_state(s["done"], line, at))
            kept = F.when(fold, F.lit("")).otherwise(held)
            return F.struct(new.alias("s"), F.concat(kept, F.when(escaped, F.lit("")).otherwise(item["c"])).alias("held"))

        return F.aggregate(items, start, put, lambda state: F.concat(_ended(state["s"]), state["held"]))

    return let(chars, folded)


def _written(item: Column, kind: Column) -> Column:
    """A text that is not null: folded as it is or with doubled quotes, or character by character."""
    text, quoted = item["text"], kind == SINGLE
    lead = item["lead"] + F.when(kind == PLAIN, 1).otherwise(2)
    shown = F.when(quoted, F.replace(text, F.lit("'"), F.lit("''"))).otherwise(text)
    quote = F.when(quoted, F.lit("'")).otherwise("")
    return F.when(kind == DOUBLE, F.concat(F.lit('"'), _double_folded(text, lead), F.lit('"'))).otherwise(
        F.concat(quote, _folded(shown, lead), quote)
    )


def scalars(items: Column) -> Column:
    """``array<struct<text, lead>>`` → each text as YAML, after ``lead`` characters of its line and a
    space; null is ``null``. However many texts there are, the writer stands once in the plan."""

    def written(item: Column) -> Column:
        text = item["text"]
        return F.when(text.isNull(), F.lit("null")).otherwise(let(style(text), lambda kind: _written(item, kind)))

    return F.transform(items, written)


def item(text: Column, lead: int) -> Column:
    return F.struct(text.alias("text"), F.lit(lead).alias("lead"))


def entries(texts: dict[str, Column], lists: dict[str, Column], body: Callable[[dict[str, Column]], Column]) -> Column:
    """``body`` of the lines ``key: text`` of all texts, and of the blocks of all lists, by key."""
    empty = F.array().cast("array<struct<text:string,lead:int>>")
    given = {key: F.coalesce(values, F.array().cast("array<string>")) for key, values in lists.items()}
    parts = [F.array(*(item(text, len(key) + 1) for key, text in texts.items())) if texts else empty]
    parts += [F.transform(values, lambda t: item(t, 1)) for values in given.values()]

    def lines(found: Column) -> Column:
        made = {key: F.concat(F.lit(f"{key}: "), found[at]) for at, key in enumerate(texts)}
        begin: Column = F.lit(len(texts) + 1)
        for key, values in given.items():
            own = F.transform(F.slice(found, begin, F.size(values)), lambda line: F.concat(F.lit("\n- "), line))
            made[key] = F.when(F.size(values) == 0, F.lit(f"{key}: []")).otherwise(F.concat(F.lit(f"{key}:"), F.array_join(own, "")))
            begin = begin + F.size(values)
        return body(made)

    return let(scalars(F.concat(*parts)), lines)
