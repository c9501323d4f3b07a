"""Opinion models: agents and proposals in, ratings and reasons out.

A model is a function of (agents, proposals) that gives rows (agent_id, proposal_id, code, score): code ``rating``, or a reason.
Models that ask a language model write prompts and hand them to a provider, which gets a list of prompts for each Arrow batch
and gives as many responses. The provider that is here answers from hashes of the prompt, so runs repeat and need no network.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import uniform
from ..functions.text import REASON_CODES, rating_scores
from .inference import continuous_step, marginals, opinion
from .spatial import nearest_cells
from .similarity import broadcast_if_small

Provider = Callable[[list[str]], list[str]]
MODELS: dict[str, Callable[[DataFrame, DataFrame], DataFrame]] = {}


def register_model(name: str) -> Callable:
    """Puts a model under a name; a name is given once."""

    def put(f):
        if name in MODELS:
            raise ValueError(f"there is a model {name}")
        MODELS[name] = f
        return f

    return put


def offline_provider(prompts: list[str]) -> list[str]:
    """A rating of 3 to 9 and reasons of 2 to 4, by the prompt's hash."""
    out = []
    for p in prompts:
        h = hashlib.sha256(p.encode()).digest()
        out.append("\n".join([f"Rating: {3 + h[0] % 7}", *(f"{c}: {2 + h[i + 1] % 3}" for i, c in enumerate(REASON_CODES))]))
    return out


def ask(prompts: DataFrame, provider: Provider = offline_provider, prompt: str = "prompt") -> DataFrame:
    """Puts response in the place of prompt."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StringType, StructType

    schema = StructType([f for f in prompts.schema.fields if f.name != prompt]).add("response", StringType())
    arrow = to_arrow_schema(schema)

    def run(batches):
        import pyarrow as pa

        for b in batches:
            answers = provider(b.column(prompt).to_pylist())
            yield pa.RecordBatch.from_arrays([*(b.column(f.name).cast(arrow.field(f.name).type) for f in schema.fields[:-1]), pa.array(answers, pa.string())], schema=arrow)

    return prompts.mapInArrow(run, schema)


def pairs(agents: DataFrame, proposals: DataFrame) -> DataFrame:
    """Every agent with every proposal, which is the set a model is asked about. Proposals are few by nature (nine in a study), and
    are broadcast while there are at most 10,000. Agents are dealt first, as a table of them may be one part of one file."""
    return agents.repartition("agent_id").crossJoin(broadcast_if_small(proposals, 10_000))


def _rated(prompts: DataFrame, provider: Provider) -> DataFrame:
    """A row is asked and read on its own, so nothing is sorted or grouped; an agent that stands twice is asked twice."""
    answered = ask(prompts.select("agent_id", "proposal_id", "prompt"), provider)
    return answered.select(F.col("agent_id").cast("string").alias("agent_id"), F.col("proposal_id").cast("string").alias("proposal_id"), F.inline(rating_scores(F.col("response"))))


def _prompted(name: str, text: Callable[[], Column], calls: int = 1) -> None:
    @register_model(name)
    def run(agents: DataFrame, proposals: DataFrame, provider: Provider = offline_provider) -> DataFrame:
        prompts = pairs(agents, proposals).select("agent_id", "proposal_id", F.concat(F.lit(f"{name}\n"), text()).alias("prompt"))
        for n in range(calls - 1):
            answered = ask(prompts.withColumn("said", F.col("prompt")), provider)
            prompts = answered.select("agent_id", "proposal_id", F.concat("said", F.lit(f"\nYour answer {n + 1} was:\n"), "response", F.lit("\nThink it over.")).alias("prompt"))
        return _rated(prompts, provider)


def _text(*columns: str) -> Callable[[], Column]:
    return lambda: F.concat_ws("\n", *columns, F.lit("Give Rating: 1 to 10, then A to L: 1 to 5."))


_prompted("census_persona", _text("profile", "description"))
_prompted("two_layer", _text("profile", "description"), calls=2)
_prompted("naive", _text("description"))
_prompted("transcript", _text("transcript", "description"))
_prompted("chain_of_thought", lambda: F.concat_ws("\n", "profile", "description", F.lit("Think step by step."), F.lit("Give Rating: 1 to 10, then A to L: 1 to 5.")))
_prompted("reflexion", _text("profile", "description"), calls=3)


@register_model("random")
def random_model(agents: DataFrame, proposals: DataFrame) -> DataFrame:
    """Ratings of 3 to 9 and reasons of 2 to 4, drawn by agent, proposal and code."""
    codes = F.explode(F.array(*map(F.lit, ["rating", *REASON_CODES])))
    rows = pairs(agents.select("agent_id"), proposals.select("proposal_id")).withColumn("code", codes)
    u = uniform(F.col("agent_id").cast("string"), F.col("proposal_id").cast("string"), F.col("code"))
    return rows.withColumn("score", F.when(F.col("code") == "rating", 3 + F.floor(u * 7)).otherwise(2 + F.floor(u * 3)).cast("int"))


@register_model("population_shares")
def population_shares(agents: DataFrame, proposals: DataFrame) -> DataFrame:
    """Six tenths support (8), three tenths oppose (3), the rest neutral (5)."""
    u = uniform(F.col("agent_id").cast("string"), F.col("proposal_id").cast("string"))
    rows = pairs(agents.select("agent_id"), proposals.select("proposal_id"))
    return rows.select("agent_id", "proposal_id", F.lit("rating").alias("code"), F.when(u < 0.6, 8).when(u < 0.9, 3).otherwise(5).alias("score"))


@register_model("nearest_cell")
def nearest_cell(agents: DataFrame, cells: DataFrame) -> DataFrame:
    """Rates by the height of the nearest cell of each proposal: up to 65 feet 8, up to 130 feet 5, above 3."""
    placed = nearest_cells(agents, cells, by="proposal_id").join(cells.select("proposal_id", "cell_id", "height_limit"), ["proposal_id", "cell_id"])
    h = F.col("height_limit")
    return placed.select("agent_id", "proposal_id", F.lit("rating").alias("code"), F.when(h <= 65, 8).when(h <= 130, 5).otherwise(3).alias("score"))


def belief_net(edges: DataFrame, stance: DataFrame, do: dict, root_prior: float = 0.5) -> DataFrame:
    """(g, rating): the stance node's probability under an intervention, as a rating; stance(g, node)."""
    p = marginals(edges, continuous_step, root_prior, do=do)
    return p.join(stance, ["g", "node"]).select("g", opinion(F.col("p")).alias("rating"))
