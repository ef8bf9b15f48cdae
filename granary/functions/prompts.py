"""Prompt templates, as Columns over their fields."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TEMPLATES: dict[str, str] = {
    "triples": "List the entities and relations of the text, at most {limit} relations, as JSON with the keys entities (entity_name, entity_type, entity_description) and relationships (source_entity, target_entity, relation, relationship_description).\nText: {text}",
    "community": "Summarise these relations of a knowledge graph in a few sentences. Each line is: entity -> entity -> relation -> description.\n{text}",
    "community_answer": "Answer the question from the summary alone.\nSummary: {summary}\nQuestion: {query}",
    "combine": "Merge the partial answers into one short answer.\n{answers}",
    "answer": "Answer from the passages; say so if they don't hold the answer.\nPassages:\n{context}\nQuestion: {query}",
    "multimodal_answer": "Answer from the passages and images.\nPassages:\n{context}\nImages:\n{images}\nQuestion: {query}",
    "relevance": "Does the document answer the query? Reply yes or no.\nQuery: {query}\nDocument: {content}",
    "layout": "Return the page's cells as a JSON list of bbox, category and text, in reading order.",
    "layout_only": "Return the page's cells as a JSON list of bbox and category, without text.",
    "ocr": "Return the page's text without headers and footers.",
    "ocr_box": "Return the text inside the box {bbox}.",
    "figure": "Describe the figure as JSON with the keys title, kind and description.",
    "keywords": "Name the key words of the question.\n{query}",
    "split_deep": "Split the question into steps that build on each other.\n{query}",
    "split_wide": "Split the question into parts that don't depend on each other.\n{query}",
    "need_retrieval": "Is more evidence needed to answer? Reply yes or no.\nQuestion: {query}\nEvidence: {context}",
    "answer_deep": "Answer step by step from the evidence of every step.\n{context}\nQuestion: {query}",
    "answer_wide": "Answer by joining the answers of the parts.\n{context}\nQuestion: {query}",
}


def render(name: str, **fields: Column | str) -> Column:
    """The template with its fields filled in; a null field is empty text."""
    out = F.lit(TEMPLATES[name])
    for k, v in fields.items():
        c = v if isinstance(v, Column) else F.lit(str(v))
        out = F.replace(out, F.lit("{" + k + "}"), F.coalesce(c.cast("string"), F.lit("")))
    return out
