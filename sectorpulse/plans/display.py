"""What the dashboard reads: stored rows re-filtered, de-duplicated and scored."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from sectorpulse.operators.aggregates import metadata
from sectorpulse.operators.dedupe import STORY_KEYS, dedupe_news, with_story_keys
from sectorpulse.operators.score import Lexicon, analyse
from sectorpulse.plans.refresh import Config
from sectorpulse.session import cut_lineage


@dataclass(frozen=True)
class Display:
    """``rows``: one scored row per story and sector; write it once, query it many times."""

    rows: DataFrame
    metadata: DataFrame


def display(stored: DataFrame, config: Config, lexicon: Lexicon | None = None) -> Display:
    # Keys are made while the texts are read by the rules, and not by a pass of their own.
    held = cut_lineage(with_story_keys(config.refilter(stored), config.keep_fragment))
    kept = dedupe_news(held, config.fuzzy, keep_fragment=config.keep_fragment).drop(*STORY_KEYS.values())
    return Display(analyse(kept, lexicon), metadata(held))
