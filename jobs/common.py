"""What the jobs share: settings, sessions, log lines, and reads as rows of any text table."""

from __future__ import annotations

import argparse
import logging
import os
import tomllib

from pyspark.sql import DataFrame, functions as F

from helixmill.functions.sequences import as_dna, clean_sequence

log = logging.getLogger("helixmill.jobs")


def settings_of(job: str, path: str | None = None) -> dict:
    """The settings of the config file beside the job, replaced by those of the file at path."""
    found = {}
    for name in filter(None, (os.path.join(os.path.dirname(os.path.abspath(__file__)), f"{job}.toml"), path)):
        with open(name, "rb") as f:
            found |= tomllib.load(f)
    return found


def arguments(job: str, about: str, paths: dict[str, str]) -> tuple[dict, dict]:
    """The command line's paths and settings."""
    parser = argparse.ArgumentParser(prog=job, description=about)
    for name, meaning in paths.items():
        parser.add_argument(f"--{name}", required=True, help=meaning)
    parser.add_argument("--config", help=f"a TOML file with other settings than {job}.toml")
    given = vars(parser.parse_args())
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    return {name: given[name] for name in paths}, settings_of(job, given["config"])


def sequences(table: DataFrame, settings: dict) -> DataFrame:
    """(genome_id, source, seq) of a text table; a null or empty source is `unknown`. Rows without an id have none.

    alphabet: "bases" for nucleotides as they stand, "text" for prose, whose letters are projected to nucleotides."""
    text = F.coalesce(F.col(f"`{settings['text']}`"), F.lit(""))
    if settings["alphabet"] not in ("bases", "text"):
        raise ValueError(f"unknown alphabet {settings['alphabet']!r}")
    source = F.coalesce(F.nullif(F.col(f"`{settings['source']}`"), F.lit("")), F.lit("unknown"))
    return table.select(F.col(f"`{settings['id']}`").alias("genome_id"), source.alias("source"), (as_dna(text) if settings["alphabet"] == "text" else clean_sequence(text)).alias("seq"))


def said(what: str, path: str, rows: int) -> None:
    log.info("%s %d rows: %s", what, rows, path)
