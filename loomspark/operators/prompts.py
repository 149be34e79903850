"""Prompts, and contexts cut to a token budget."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from loomspark.functions.text import strip

#: Share of the context that each step keeps, and the least characters it may come to (fixed values).
SHRINK, LEAST = 0.75, 128


def filled(template: str, fields: dict[str, Column]) -> Column:
    """The template with {name} replaced by columns, literally."""
    out = F.lit(template)
    for name, c in fields.items():
        out = F.replace(out, F.lit("{" + name + "}"), F.coalesce(c.cast("string"), F.lit("")))
    return out


#: The headings of a prompt, what stands under the second, and the place of the question's parts.
HEADINGS = {
    "instruction": "### Instruction: ",
    "output": "### Output structure:",
    "profile": "### Patient profile: ",
    "scenario": "### Clinical scenario: ",
    "question": "### Question: ",
    "answer": "### Answer:",
}
OUTPUT = "- Explanation: Your step-by-step reasoning\n- Final answer: Your final answer (e.g. (A), (B), ...)"
#: What is asked for, and what is added where there are retrieved texts; of our own words.
INSTRUCTION = "Choose the best option for the patient and situation below, and explain it in the given structure."
WITH_CONTEXT = " Use the retrieved excerpts as evidence where they help."


def mcqa_prompt(question: Column, options: Column, context: Column | None = None, profile: Column | None = None, scenario: Column | None = None, instruction: str = INSTRUCTION) -> Column:
    """A multiple-choice prompt: headed sections apart by blank lines; profile, scenario and context are left out where they
    are null or blank; options by label as (A): text."""
    lines = F.array_join(F.transform(F.array_sort(F.map_entries(options)), lambda e: F.concat(F.lit("("), F.upper(e["key"]), F.lit("): "), e["value"])), "\n")
    some = lambda c: F.when(F.coalesce(strip(c.cast("string")), F.lit("")) != "", strip(c.cast("string")))
    headed = lambda name, c: F.concat(F.lit(HEADINGS[name]), some(c))
    given = some(context) if context is not None else F.lit(None).cast("string")
    head = F.concat(F.lit(HEADINGS["instruction"] + instruction), F.when(given.isNotNull(), WITH_CONTEXT).otherwise(""))
    parts = [head, F.lit(HEADINGS["output"] + "\n" + OUTPUT)]
    parts += [headed(n, c) for n, c in (("profile", profile), ("scenario", scenario)) if c is not None]
    parts += [F.concat(F.lit(HEADINGS["question"]), question.cast("string"), F.lit("\n"), lines), given, F.lit(HEADINGS["answer"])]
    return F.concat_ws("\n\n", *parts)  # which leaves nulls out


def lengths(most: int, least: int = LEAST) -> list[int]:
    """Characters of each text that are tried, one after the other."""
    out = [most]
    while out[-1] > least:
        out.append(max(least, int(out[-1] * SHRINK)))
    return out


def laid_out(texts: list[str], most: int) -> str:
    """text.format_context of one list, in a worker."""
    if not texts:
        return ""

    def clipped(t: str) -> str:
        t = t.strip()
        return t if len(t) <= most else t[:most].rsplit(" ", 1)[0] + "..."

    blocks = "\n\n".join(f"[{i}] Text:\n{clipped(t)}" for i, t in enumerate(texts, 1))
    return f"### Retrieved excerpt{'' if len(texts) == 1 else 's'} (top-{len(texts)})\n{blocks}"


def budgeted(df: DataFrame, prompt: str, texts: str, out: str, budget: int, count: Callable[[list[str]], list[int]], most: int = 4500, bare: str | None = None) -> DataFrame:
    """df with the prompt whose retrieved texts (at {context}) are laid out anew with each text clipped to fewer characters
    until its tokens fit; one that fits with none is an error. Rows without texts take the prompt in column `bare`, if any.

    count gives the tokens of a list of prompts at once; a turn counts the prompts of a batch that don't fit yet, first those
    of the length that half of the lengths left are longer than, and then next to it: a row takes the greatest length
    that fits and whose longer neighbour doesn't.
    """
    schema = StructType([*df.schema.fields, StructField(out, StringType())])
    steps = lengths(most)

    def fit(prompts_, contexts, bares):
        n = len(prompts_)
        made: dict[tuple[int, int], tuple[bool, str]] = {}

        def tried(asked):
            new = [x for x in dict.fromkeys(asked) if x not in made]
            filled = [bares[i] if not contexts[i] and bares[i] is not None else prompts_[i].replace("{context}", laid_out(contexts[i], steps[s])) for i, s in new]
            for x, text, size in zip(new, filled, count(filled) if filled else [], strict=True):
                made[x] = (size <= budget, text)

        low, high = [0] * n, [len(steps) - 1 if contexts[i] else 0 for i in range(n)]
        tried((i, 0) for i in range(n))
        for i in range(n):
            if made[i, 0][0]:
                high[i] = 0
        while open_ := [i for i in range(n) if low[i] < high[i]]:
            middle = {i: (low[i] + high[i]) // 2 for i in open_}
            tried((i, s) for i, s in middle.items())
            for i, s in middle.items():
                if made[i, s][0]:
                    high[i] = s
                else:
                    low[i] = s + 1
        # a longer text may have fewer tokens at times: go back as long as the step before fits too
        back = list(range(n))
        while back:
            tried((i, low[i]) for i in back)
            tried((i, low[i] - 1) for i in back if low[i])
            back = [i for i in back if low[i] and made[i, low[i] - 1][0]]
            for i in back:
                low[i] -= 1
        for i in range(n):
            if not made[i, low[i]][0]:
                raise ValueError(f"the prompt is over its budget of {budget} tokens with texts of {steps[low[i]]} characters")
        return [made[i, low[i]][1] for i in range(n)]

    def run(frames):
        for f in frames:
            contexts = [[] if c is None else [x or "" for x in c] for c in f[texts]]
            yield f.assign(**{out: fit(list(f[prompt]), contexts, list(f[bare]) if bare else [None] * len(f))})

    return df.mapInPandas(run, schema)


def within_budget(df: DataFrame, prompt: str, context: str, out: str, budget: int, count: Callable[[str], int]) -> DataFrame:
    """df with the prompt whose context (at {context}), one text, is cut from its end until its tokens fit; a prompt that
    never fits is an error. budgeted() clips each of several texts."""
    schema = StructType([*df.schema.fields, StructField(out, StringType())])

    def fit(p: str, c: str | None) -> str:
        size = len(c or "")
        while True:
            text = p.replace("{context}", (c or "")[:size])
            if count(text) <= budget:
                return text
            if size <= LEAST:
                raise ValueError("the prompt is over its budget without its context")
            size = max(LEAST, int(size * SHRINK))

    def run(frames):
        for f in frames:
            yield f.assign(**{out: [fit(p, c) for p, c in zip(f[prompt], f[context], strict=True)]})

    return df.mapInPandas(run, schema)
