"""Text columns: cleaning, prompts, normalisation and the space tokenizer."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import Rag, Specials

# ASCII punctuation, and what counts as white space in Unicode.
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
SPACES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0                　"
ROLES = ("system", "user", "assistant")

Tokenizer = Callable[[Column], Column]


def clean_text(text: Column, extra: tuple[str, ...] = ()) -> Column:
    """Placeholders inside data are parted, so that they are no special tokens; ``extra`` names more of them."""
    for name in ("RET", "MEM", *extra):
        text = F.replace(text, F.lit(f"<{name}>"), F.lit(f"< {name} >"))
    return text


def space_tokens(text: Column) -> Column:
    """The text cut at single spaces; an empty text has no tokens. ``array_join(tokens, ' ')`` gives the text again."""
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, " ", -1))


def query_prefix(query: Column, doc: Column) -> Column:
    return F.concat(F.lit("Query: "), query, F.lit("\n Document: "), doc)


def doc_section(n_mems: Column, mem: str = "<MEM>") -> Column:
    """``Document k:`` with its placeholders for every document, without separators."""
    return F.array_join(F.transform(n_mems, lambda n, k: F.concat(F.lit("Document "), k.cast("string"), F.lit(":"), F.repeat(F.lit(mem), n.cast("int")))), "")


def spaced_section(n_mems: Column, mem: str = "<MEM>") -> Column:
    """The section with every placeholder a token of its own under the space tokenizer."""
    return F.array_join(F.transform(n_mems, lambda n, k: F.concat(F.lit("Document "), k.cast("string"), F.lit(":"), F.repeat(F.lit(f" {mem}"), n.cast("int")))), " ")


def rag_prompt(config: Rag, documents: Column, question: Column) -> Column:
    """The user prompt: documents are put in first, then the question."""
    return F.replace(F.replace(F.lit(config.user_prompt), F.lit("[documents]"), documents), F.lit("[question]"), question)


def render_chat(system: Column, user: Column, assistant: Column | None = None) -> Column:
    """A fixed template: each turn opens with its role and closes with a mark; a null assistant turn is left out."""
    turn = lambda role, content: F.concat(F.lit(f"<|{role}|> "), content, F.lit(" <|end|>"))
    head = F.concat(turn("system", system), F.lit(" "), turn("user", user))
    if assistant is None:
        return head
    return F.concat(head, F.coalesce(F.concat(F.lit(" "), turn("assistant", assistant)), F.lit("")))


def normalize(text: Column) -> Column:
    """Lower case without ASCII punctuation, white space collapsed; articles and other punctuation stay."""
    bare = F.translate(F.lower(text), PUNCTUATION, "")
    return F.trim(F.regexp_replace(bare, f"[{SPACES}]+", " "))


def words(text: Column) -> Column:
    """The parts between white space."""
    return F.filter(F.split(text, f"[{SPACES}]+", -1), lambda x: x != "")


def decode(tokens: Column, specials: Specials) -> Column:
    """Tokens as text, special tokens left out."""
    skipped = [specials.mem, specials.ae, specials.bos, specials.eos, specials.pad]
    return F.array_join(F.filter(tokens, lambda x: ~x.isin(skipped)), " ")
