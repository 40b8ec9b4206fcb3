"""Text functions as column expressions: ids, normalisation, answers, model output, prompts, labels."""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

#: ASCII punctuation and English articles that answer normalisation removes.
PUNCTUATION = string.punctuation
ARTICLES = ("a", "an", "the")
#: Markers of the reasoning channel.
FINAL_MARKER, FINAL_ENDS, FINAL_FALLBACK = "<|channel|>final<|message|>", ("<|end|>", "<|return|>"), "assistantfinal"


def content_id(text: Column, prefix: str = "") -> Column:
    """Prefix and MD5 of the text; equal contents share an id."""
    return F.concat(F.lit(prefix), F.md5(F.encode(text, "UTF-8")))


def chunk_text(title: Column, body: Column) -> Column:
    return F.concat(title, F.lit("\n"), body)


def cache_key(*parts: Column) -> Column:
    return F.sha2(F.encode(F.concat_ws("|", *parts), "UTF-8"), 256)


def subset_hash(sorted_ids: Column) -> Column:
    """SHA-1 over an array of ids in order."""
    return F.sha1(F.encode(F.array_join(sorted_ids, "|"), "UTF-8"))


def words(text: Column) -> Column:
    """White-space words; no empty ones."""
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def normalize_answer(text: Column) -> Column:
    """Lower case, no ASCII punctuation, no articles, single spaces."""
    bare = F.translate(F.lower(text), PUNCTUATION, "")
    return F.array_join(F.filter(F.split(bare, r"\s+"), lambda w: ~w.isin("", *ARTICLES)), " ")


def exact_match(predicted: Column, golds: Column) -> Column:
    """1.0 if the prediction equals any gold answer after normalisation."""
    p = normalize_answer(predicted)
    return F.exists(golds, lambda g: normalize_answer(g) == p).cast("double")


def token_f1(predicted: Column, gold: Column) -> Column:
    """F1 of the two bags of words; 0 if no word is shared."""
    p, g = (F.split(normalize_answer(x), " ") for x in (predicted, gold))
    pairs = F.filter(F.array_distinct(p), lambda w: w != "")
    return F.get(
        F.transform(  # one-element arrays bind what is used more than once
            F.array(F.struct(p.alias("p"), g.alias("g"), pairs.alias("d"))),
            lambda s: _f1(
                F.aggregate(s["d"], F.lit(0), lambda a, w: a + F.least(_count(s["p"], w), _count(s["g"], w))), s["p"], s["g"]
            ),
        ),
        F.lit(0),
    )


def _count(bag: Column, word: Column) -> Column:
    return F.size(F.filter(bag, lambda x: x == word))


def _f1(same: Column, p: Column, g: Column) -> Column:
    precision, recall = same / F.size(p), same / F.size(g)
    return F.when(same == 0, 0.0).otherwise(2 * precision * recall / (precision + recall))


def recall_at(retrieved: Column, gold: Column, k: int) -> Column:
    """Share of distinct gold titles among the first k retrieved; 0 without gold."""
    wanted = F.array_distinct(gold)
    found = F.size(F.array_intersect(wanted, F.slice(retrieved, 1, k)))
    return F.when(F.size(wanted) == 0, 0.0).otherwise(found / F.size(wanted))


def extract_answer(raw: Column) -> Column:
    """After the last ``Answer:``, the first line that is not blank, without outer quotes and full stops; else ``unknown``."""
    last = F.element_at(F.split(raw, "Answer:"), -1)
    line = F.get(F.filter(F.split(last, "\n"), lambda x: F.trim(x) != ""), F.lit(0))
    bare = F.regexp_replace(F.trim(line), r"^[\"'. ]+|[\"'. ]+$", "")
    return F.coalesce(F.nullif(bare, F.lit("")), F.lit("unknown"))


def extract_first_answer(raw: Column) -> Column:
    """After the first ``Answer:``, trimmed; the whole text without one."""
    parts = F.split(raw, "Answer:", 2)
    return F.trim(F.element_at(parts, -1))


def stripped(text: Column) -> Column:
    """Without white space of any kind at its ends."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def strip_reasoning(raw: Column) -> Column:
    """The final channel's text: after the last marker, up to a terminator.

    Without the marker, a text that begins with ``analysis`` ends in what follows its last fallback marker; any other is
    left as it is.
    """
    after = F.element_at(F.split(raw, r"<\|channel\|>final<\|message\|>"), -1)
    ended = stripped(F.get(F.split(after, r"<\|end\|>|<\|return\|>|<\|start\|>"), F.lit(0)))
    thought = raw.rlike(r"^\s*analysis") & raw.contains(FINAL_FALLBACK)
    return F.when(raw.contains(FINAL_MARKER), ended).when(thought, stripped(F.element_at(F.split(raw, FINAL_FALLBACK), -1))).otherwise(raw)


def unfence(raw: Column) -> Column:
    """Model output without code fences."""
    return F.trim(F.regexp_replace(F.trim(raw), r"^```[a-z]*\s*|\s*```$", ""))


def parse_entities(raw: Column) -> Column:
    """The strings of ``{"entities": [...]}``; from a broken object, what can be salvaged by pattern."""
    parsed = F.from_json(unfence(raw), "entities array<string>")["entities"]
    listed = F.regexp_extract(raw, r'"entities"\s*:\s*\[([^\]]*)', 1)
    saved = F.regexp_extract_all(listed, F.lit(r'"([^"]+)"'), F.lit(1))
    return F.array_distinct(F.coalesce(parsed, saved))


#: A JSON string, and a colon or comma with the space around it.
_STRING, _COLON, _COMMA = r'"(?:[^"\\]|\\.)*"', r"\s*:\s*", r"\s*,\s*"


def _salvaged(raw: Column, fields: tuple[str, ...], kind: str, rest: str, ending: str = "") -> Column:
    """Objects found one by one in broken output: the named string fields in order, then ``rest``."""
    named = _COMMA.join(f'"{f}"{_COLON}{_STRING}' for f in fields)
    objects = F.regexp_extract_all(raw, F.lit(rf"(?s)(\{{\s*{named}{rest})"), F.lit(1))
    return F.transform(objects, lambda o: F.from_json(F.concat(o, F.lit(ending)), kind))


def _first_filled(parsed: Column, saved: Column) -> Column:
    return F.when(F.size(F.coalesce(parsed, F.array())) > 0, parsed).otherwise(saved)


def parse_propositions(raw: Column) -> Column:
    """Array of (text, entities) of ``{"propositions": [...]}``, object by object if the whole is broken."""
    kind = "text string, entities array<string>"
    parsed = F.from_json(unfence(raw), "propositions array<struct<text:string,entities:array<string>>>")["propositions"]
    saved = _salvaged(raw, ("text",), kind, rf'{_COMMA}"entities"{_COLON}\[[^\]]*\]\s*\}}')
    fine = lambda p: p["text"].isNotNull() & (F.trim(p["text"]) != "")
    return _first_filled(F.filter(parsed, fine), F.filter(saved, fine))


def parse_typed_entities(raw: Column) -> Column:
    """Array of (name, type, description) of ``{"entities": [...]}``, also of output that breaks off."""
    fields = ("name", "type", "description")
    kind = ", ".join(f"{f} string" for f in fields)
    parsed = F.from_json(unfence(raw), f"entities array<struct<{','.join(f'{f}:string' for f in fields)}>>")["entities"]
    fine = lambda e: e["name"].isNotNull() & (e["name"] != "")
    return _first_filled(F.filter(parsed, fine), _salvaged(raw, fields, kind, "", "}"))


def parse_relations(raw: Column) -> Column:
    """Array of (source, target, description, strength); a missing, zero or unreadable strength is 5.

    Of output that breaks off, a last relation counts once its description is whole.
    """
    fields = ("source", "target", "description")
    kind = ", ".join(f"{f} string" for f in (*fields, "strength"))
    parsed = F.from_json(unfence(raw), f"relationships array<struct<{','.join(f'{f}:string' for f in (*fields, 'strength'))}>>")["relationships"]
    fine = lambda r: (F.coalesce(r["source"], F.lit("")) != "") & (F.coalesce(r["target"], F.lit("")) != "")
    saved = _salvaged(raw, fields, kind, rf'(?:{_COMMA}"strength"{_COLON}\d+)?', "}")
    return F.transform(
        _first_filled(F.filter(parsed, fine), saved),
        lambda r: F.struct(r["source"].alias("source"), r["target"].alias("target"), r["description"].alias("description"), strength(r["strength"]).alias("strength")),
    )


def strength(raw: Column) -> Column:
    n = raw.try_cast("double")
    return F.when(n.isNull() | (n == 0), 5.0).otherwise(n)


def parse_rewrite(raw: Column, question: Column) -> Column:
    """The ``query`` of a rewrite, else what a pattern finds, else the question itself."""
    found = F.coalesce(F.get_json_object(unfence(raw), "$.query"), F.nullif(F.regexp_extract(raw, r'"query"\s*:\s*"([^"]*)', 1), F.lit("")))
    return F.coalesce(F.nullif(F.trim(found), F.lit("")), question)


def constrain(entities: Column, allowed: Column) -> Column:
    """Entities of the allowed set, order and repeats kept."""
    return F.filter(entities, lambda e: F.array_contains(allowed, e))


def merged_description(summary: Column, descriptions: Column) -> Column:
    return F.coalesce(F.nullif(summary, F.lit("")), F.array_join(F.array_distinct(descriptions), " "))


def numbered(passages: Column) -> Column:
    """Passages under numbered heads, as a prompt lists them."""
    return F.array_join(F.transform(passages, lambda p, i: F.concat(F.lit("[Passage "), (i + 1).cast("string"), F.lit("]\n"), p)), "\n\n")


def ellipsis(text: Column, most: int = 60) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most - 3), F.lit("..."))).otherwise(text)


def safe_name(text: Column, number: Column, most: int = 60) -> Column:
    """A file name: kept characters, single spaces, a cut stem, a two-digit number in front."""
    kept = F.trim(F.regexp_replace(F.regexp_replace(text, r"[^A-Za-z0-9 _.-]", ""), r"\s+", " "))
    return F.format_string("%02d_%s.pdf", number.cast("int"), F.substring(kept, 1, most))


def split_system(messages: Column) -> Column:
    """System texts joined, and the other turns with the assistant's role renamed to ``model``."""
    system = F.array_join(F.transform(F.filter(messages, lambda m: m["role"] == "system"), lambda m: m["text"]), "\n")
    turns = F.transform(
        F.filter(messages, lambda m: m["role"] != "system"),
        lambda m: F.concat(F.when(m["role"] == "assistant", "model").otherwise(m["role"]), F.lit(": "), m["text"]),
    )
    return F.struct(system.alias("system"), turns.alias("turns"))
