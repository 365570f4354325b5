"""Questions about one graph, answered as text.

Each method is one lookup on the tables, rendered, with a message where it finds
nothing. Side tables (centrality, complexity, codifiability) may not have been made;
answers from them then say so, which is another thing than finding no row.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import classify as K
from . import graph, render, resolve, score


@dataclass
class Answers:
    tables: dict[str, DataFrame]
    centrality: DataFrame | None = None
    complexity: DataFrame | None = None
    codifiability: DataFrame | None = None

    @property
    def spark(self) -> SparkSession:
        return self.tables["acts"].sparkSession

    def _node(self, eid: str, act: str) -> DataFrame:
        return self.spark.range(1).select(K.section_node(F.lit(act), F.lit(eid)).alias("node_id"))

    def resolve_definition(self, term: str, act: str, section_eid: str | None = None) -> str:
        rows = resolve.resolve_definition(self.tables["terms"], self.tables["acts"], term, act, section_eid)
        return render.answer(render.definitions(rows), f"'{term}' has no definition in {act}" + (f" for {section_eid}." if section_eid else "."))

    def find_all_definitions(self, term: str) -> str:
        rows = resolve.find_all_definitions(self.tables["terms"], self.tables["acts"], term)
        return render.answer(render.definitions(rows), f"'{term}' has no definition.", "\n\n---\n\n")

    def act_terms(self, act: str) -> str:
        rows = resolve.act_terms(self.tables["terms"], act)
        lines = render.answer(render.terms(rows), "")
        title = resolve.act_title(self.tables["acts"], act).first()
        return f"{lines.count(chr(10)) + 1} defined terms in {title.title if title else act} ({act}):\n{lines}" if lines else f"{act} defines no terms."

    def cross_references(self, eid: str, act: str) -> str:
        rows = graph.fan_out(self.tables["ref_edges"], self._node(eid, act))
        return render.answer(render.references(rows.orderBy("target", "pos")), f"{eid} in {act} refers to nothing.")

    def impact(self, eid: str, act: str, max_hops: int = 3) -> str:
        hits = graph.impacted_by(self.tables["ref_edges"], self._node(eid, act), max_hops=max_hops)
        if self.centrality is not None:
            hits = graph.ranked_impact(hits, self.centrality)
        return render.answer(render.impact(hits), f"Nothing cites {eid} in {act} within {max_hops} hops.")

    def entities(self, eid: str, act: str) -> str:
        own = self.tables["mentions"].join(self._node(eid, act).withColumnRenamed("node_id", "src"), "src", "left_semi")
        rows = graph.entities_in_sections(own, self.tables["terms"]).orderBy("display_term")
        return render.answer(render.entities(rows), f"{eid} in {act} mentions no entity.")

    def find_entity(self, display_term: str) -> str:
        rows = resolve.find_entity(self.tables["terms"], self.tables["acts"], display_term).orderBy("act_frbr_uri", "section_eid")
        lines = render.answer(render.homonyms(rows), "")
        return f"Entities of that name, act by act (which need not be the same office):\n{lines}" if lines else f"No entity is called '{display_term}'."

    def multi_act_terms(self, min_acts: int = 3) -> str:
        return render.answer(render.multi_act(resolve.multi_act_terms(self.tables["terms"], min_acts)), f"No term is defined in {min_acts} acts.")

    def complexity_of(self, act: str) -> str:
        if self.complexity is None:
            return render.not_available("complexity")
        return render.answer(render.complexity(self.complexity.where(F.col("act_frbr_uri") == act)), f"{act} has no complexity record.")

    def codifiability_of(self, eid: str, act: str) -> str:
        if self.codifiability is None:
            return render.not_available("codifiability")
        rows = self.codifiability.where((F.col("act_frbr_uri") == act) & (F.col("eid") == eid))
        return render.answer(render.codifiability(rows), f"{eid} in {act} has no codifiability record.")

    def codifiability_summary(self, act: str) -> str:
        if self.codifiability is None:
            return render.not_available("codifiability")
        rows = score.codifiability_summary(self.codifiability.where(F.col("act_frbr_uri") == act))
        return render.answer(render.act_summary(rows), f"{act} has no codifiability records.")
