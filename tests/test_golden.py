"""A link index that is known from elsewhere against the one that is made here.

GOLDEN_PARAMS names a parameter file, whose truth may be missing, GOLDEN_LINKS the link index that it
should give and GOLDEN_ALIASES, if set, an alias table; without the first two nothing is compared.
GOLDEN_WORDS is a word list, comma-separated; GOLDEN_WHOLE=1 takes one quality over whole references."""

import os
from functools import partial
from pathlib import Path

import pytest

from quillmatch.operators.quality import entropy_quality
from quillmatch.operators.stats import tokenize
from quillmatch.plans import resolve as resolution
from quillmatch.plans.params import load
from quillmatch.sources.readers import read_aliases, read_references, resolve_duplicates

PARAMS, LINKS, ALIASES = (os.environ.get(f"GOLDEN_{name}") for name in ("PARAMS", "LINKS", "ALIASES"))


def pairs(clusters: dict[str, str]) -> set[tuple[str, str]]:
    ids = sorted(clusters)
    return {(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if clusters[a] == clusters[b]}


@pytest.mark.skipif(not (PARAMS and LINKS), reason="GOLDEN_PARAMS and GOLDEN_LINKS are not set")
def test_golden_link_index(spark, monkeypatch):
    if os.environ.get("GOLDEN_WHOLE") == "1":
        monkeypatch.setattr(resolution, "entropy_quality", partial(entropy_quality, halves=False))
    words = spark.createDataFrame([(w,) for w in os.environ.get("GOLDEN_WORDS", "").split(",") if w], "word string")
    p = load(PARAMS).with_(truthFileName="", runIterationProfile=False)
    source = str(Path(PARAMS).parent / p.inputFileName)
    refs = resolve_duplicates(tokenize(read_references(spark, source, p.delimiter, p.hasHeader), p))
    made = resolution.resolve(refs, p, words=words, aliases=read_aliases(spark, ALIASES) if ALIASES else None)
    link = {r["refID"]: r["clusterID"] for r in made.link.collect()}
    tokens = {r["refID"]: r["tokens"] for r in made.refs.collect()}
    lines = [line.split(", ", 2) for line in Path(LINKS).read_text().splitlines()[1:] if line.strip()]
    golden = {x[0]: x[1] for x in lines}
    assert link.keys() == golden.keys()
    differ = {x[0]: (x[2].split(), tokens[x[0]]) for x in lines if len(x) > 2 and x[2].split() != tokens[x[0]]}
    only_golden, only_made = pairs(golden) - pairs(link), pairs(link) - pairs(golden)
    print(f"{len(golden)} references, {len(pairs(golden))} pairs, {len(set(golden.values()))} clusters; here {len(set(link.values()))}")
    print("tokens that differ", differ, "pairs missed", sorted(only_golden), "pairs made beside", sorted(only_made), sep="\n")
    assert not differ and not only_golden and not only_made
