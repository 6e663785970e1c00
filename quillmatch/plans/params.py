"""Parameters of a run, and the key=value files that hold them."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace
from pathlib import Path

from quillmatch.functions.similarity import COMPARATORS
from quillmatch.functions.text import TOKENIZERS


class ParameterError(ValueError):
    """All that is wrong with a parameter file, line by line."""


@dataclass(frozen=True)
class Params:
    """Names and defaults as parameter files use them."""

    inputFileName: str = ""
    delimiter: str = ","
    hasHeader: bool = False
    tokenizerType: str = "Splitter"
    truthFileName: str = ""
    runIterationProfile: bool = False
    addRefsToLinkIndex: bool = False
    runGlobalCorrection: bool = False
    globalCorrectionDetail: bool = False
    learnTokenVariants: bool = False
    minFreqStdToken: int = 5
    minLenStdToken: int = 3
    maxFreqErrToken: int = 3
    beta: int = 2
    blockByPairs: bool = True
    #: pairs of tokens make one key without a separator, as AB with CDEF and ABC with DEF
    strictBlockKeys: bool = False
    minBlkTokenLen: int = 4
    excludeNumericBlocks: bool = True
    blockCorrection: bool = False
    blockCorrectionDetail: bool = False
    epsilon: float = 0.50
    epsilonIterate: float = 0.00
    mu: float = 0.50
    muIterate: float = 0.10
    comparator: str = "ScoringMatrixStd"
    matrixNumTokenRule: bool = False
    matrixInitialRule: bool = False
    sigma: int = 12
    removeDuplicateTokens: bool = False
    removeExcludedBlkTokens: bool = True

    @property
    def inputPrefix(self) -> str:
        return self.inputFileName.rpartition(".")[0]

    def problems(self) -> list[str]:
        checks = [
            (self.beta >= 2, f"beta {self.beta} must be 2 or more"),
            (self.sigma > self.beta, f"sigma {self.sigma} must be larger than beta {self.beta}"),
            (0 < self.mu <= 1, f"mu {self.mu} must be in (0, 1]"),
            (0 <= self.muIterate <= 1, f"muIterate {self.muIterate} must be in [0, 1]"),
            (0 < self.epsilon <= 1, f"epsilon {self.epsilon} must be in (0, 1]"),
            (0 <= self.epsilonIterate <= 1, f"epsilonIterate {self.epsilonIterate} must be in [0, 1]"),
            (self.minFreqStdToken > self.maxFreqErrToken, f"minFreqStdToken {self.minFreqStdToken} must be greater than maxFreqErrToken {self.maxFreqErrToken}"),
            (self.tokenizerType in TOKENIZERS, f"unknown tokenizerType {self.tokenizerType}"),
            (self.comparator in COMPARATORS, f"unknown comparator {self.comparator}"),
        ]
        return [said for ok, said in checks if not ok]

    def checked(self) -> Params:
        if found := self.problems():
            raise ParameterError("\n".join(found))
        return self

    def with_(self, **changes) -> Params:
        return replace(self, **changes)


#: Accepted in files without effect.
IGNORED = ("runClusterMetrics", "createFinalJoin")
DELIMITERS = (",", ";", ":", "|", "\t")


def _value(kind: str, text: str):
    if kind == "bool":
        if text not in ("True", "False"):
            raise ValueError("must be True or False")
        return text == "True"
    if kind == "int":
        if not text.isdigit():
            raise ValueError("must be a whole number")
        return int(text)
    if kind == "float":
        return float(text)
    return text


def parse(text: str) -> Params:
    """Lines name=value up to the first blank one; lines that begin with # are comments. Each file
    starts from the defaults. All errors are reported together."""
    kinds = {f.name: f.type for f in fields(Params)}
    found: dict = {}
    wrong: list[str] = []
    for number, raw in enumerate(text.splitlines(), 1):
        line = raw.rstrip("\r\n")
        if not line.strip():
            break
        if line.lstrip().startswith("#"):
            continue
        name, equals, rest = line.partition("=")
        name, value = name.strip(), rest.split("=")[0]
        if not equals:
            wrong.append(f"line {number}: no equal sign: {line}")
        elif name == "delimiter":
            mark = "\t" if value in ("\t", "\\t") or (value and not value.strip(" ").strip("\t") and "\t" in value) else value.strip()
            if mark in DELIMITERS:
                found[name] = mark
            else:
                wrong.append(f"line {number}: unknown delimiter {value!r}")
        elif name in kinds:
            try:
                found[name] = _value(kinds[name], value.strip())
            except ValueError as e:
                wrong.append(f"line {number}: {name} {e}: {value.strip()!r}")
        elif name not in IGNORED:
            wrong.append(f"line {number}: unknown parameter {name}")
    params = Params(**found)
    wrong += params.problems()
    if wrong:
        raise ParameterError("\n".join(wrong))
    return params


def load(path: str) -> Params:
    return parse(Path(path).read_text(encoding="utf-8"))


def parameter_files(path: str) -> list[str]:
    """The paths in a batch list, up to the first blank line."""
    out = []
    for line in Path(path).read_text(encoding="utf-8").splitlines():
        if not line.strip():
            break
        out.append(line.strip())
    return out
