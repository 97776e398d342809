"""Prompt texts as column expressions."""

from __future__ import annotations

import re
from importlib import resources

from pyspark.sql import Column
from pyspark.sql import functions as F

from shelfloom.functions.text import image_uri
from shelfloom.schemas import Target

_SLOT = re.compile(r"\{\{([A-Z_]+)\}\}")


def load_template(name: str) -> str:
    """The packaged wording of a prompt: titles, descriptions, highlights, title_lines, ..."""
    return resources.files("shelfloom.templates").joinpath(f"{name}.txt").read_text("utf-8")


def pieces(template: str, language: str) -> list[tuple[str, str]]:
    """Cut a template at its slots: ("text", ...) and ("slot", NAME), the language filled in."""
    filled = template.replace("{{LANGUAGE}}", language)
    parts: list[tuple[str, str]] = []
    end = 0
    for found in _SLOT.finditer(filled):
        parts.append(("text", filled[end : found.start()]))
        parts.append(("slot", found.group(1)))
        end = found.end()
    parts.append(("text", filled[end:]))
    return [p for p in parts if p[1]]


def fill(template: str, language: str, slots: dict[str, Column]) -> Column:
    """The template with columns in its slots; data is never scanned for slot names."""
    return F.concat(
        *[F.lit(v) if kind == "text" else slots[v] for kind, v in pieces(template, language)]
    )


def row_json(columns: list[str]) -> Column:
    """A row as JSON text with its null fields kept."""
    return F.to_json(F.struct(*[F.col(f"`{c}`") for c in columns]), {"ignoreNullFields": "false"})


def lines(col: Column) -> Column:
    """Array items one per line, null items as empty lines."""
    return F.array_join(col, "\n", "")


def example_texts(examples: Column) -> Column:
    """An array of examples as the texts that prompts copy: lines and sections per target."""

    def outputs(field: str) -> Column:
        return lines(F.transform(examples, lambda e: F.concat(e["id"], F.lit(": "), e[field])))

    return F.struct(
        lines(F.transform(examples, lambda e: e["properties"])).alias("inputs"),
        outputs("title").alias("title_lines"),
        outputs("description").alias("description_lines"),
        example_section(examples, "title").alias("title_section"),
        example_section(examples, "description").alias("description_section"),
    )


def example_section(examples: Column, field: str) -> Column:
    """The section of worked examples, empty when there are none."""
    turns = F.transform(
        examples,
        lambda e: F.concat(
            F.lit("**User:**\n"), e["properties"], F.lit("\n\n**Model:**\n"), e[field]
        ),
    )
    body = F.concat(F.lit("## Examples\n\n"), F.array_join(turns, "\n\n"), F.lit("\n\n"))
    return F.when(F.size(examples) > 0, body).otherwise("")


def chunk_prompt(target: Target, language: str, examples: Column, properties: Column) -> Column:
    """One prompt for many items, answered by one ``id: text`` line per item.

    ``examples`` are the texts of ``example_texts``.
    """
    return fill(
        load_template(f"{target.column}_lines"),
        language,
        {
            "EXAMPLE_INPUTS": examples["inputs"],
            "EXAMPLE_OUTPUTS": examples[f"{target.example_field}_lines"],
            "INPUTS": lines(properties),
        },
    )


def sectioned_prompt(
    target: Target, language: str, examples: Column, inputs: Column, template: str | None = None
) -> Column:
    """Instructions, examples and input under headings.

    ``examples`` are the texts of ``example_texts``, ``inputs`` is the text of the last part.
    """
    wording = template if template is not None else load_template(target.name)
    instructions = wording.replace("{{LANGUAGE}}", language)
    return F.concat(
        F.lit(f"## System Instructions\n\n{instructions}\n\n"),
        examples[f"{target.example_field}_section"],
        F.lit("## Input\n\n"),
        inputs,
    )


def products_with_images(products: Column) -> Column:
    """Input text of items given as structs of properties and image note."""
    return F.array_join(
        F.transform(products, lambda p: F.concat(p["properties"], F.lit("\n"), p["image_info"])),
        "\n\n",
    )


def batch_input(
    properties: Column,
    image_url: Column,
    webpage_content: Column,
    bucket: str = "",
    use_images: bool = False,
    web_done: bool = False,
) -> Column:
    """Input text of one item: its properties, then its image and page where there are any."""
    text = [properties, F.lit("\n")]
    if use_images:
        note = F.concat(F.lit("image_url: "), image_uri(image_url, bucket), F.lit("\n"))
        text.append(F.when(image_url != "", note).otherwise(""))
    if web_done:
        note = F.concat(F.lit("webpage_content: "), webpage_content, F.lit("\n"))
        text.append(F.when(webpage_content != "", note).otherwise(""))
    return F.concat(*text)


def context_prompt(instructions: str, context_json: Column, page_info: Column) -> Column:
    """Instructions followed by the item's context and, where known, its landing page."""
    return F.concat(F.lit(instructions), F.lit("Context: "), context_json, F.lit("\n\n"), page_info)


def page_note(page_text: Column, enabled: bool = True) -> Column:
    """The landing-page part of a context prompt, empty without a page."""
    if not enabled:
        return F.lit("")
    note = F.concat(F.lit("Website: "), page_text, F.lit("\n\n"))
    return F.when(page_text != "", note).otherwise("")


def attribute_instructions(attribute: str, language: str, meaning: str = "") -> str:
    """Wording of the request that asks for one attribute of a product."""
    explained = f" Here, {attribute} means: {meaning}." if meaning else ""
    return load_template("attribute").strip().format(
        attribute=attribute, language=language, explained=explained
    )
