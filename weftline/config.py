"""Parameters of the engine: keyword-only, checked when they are made."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field


@dataclass(frozen=True, kw_only=True)
class Specials:
    """Reserved elements of token sequences; a plugged-in tokenizer must have distinct ids for them."""

    mem: str = "<MEM>"
    ae: str = "<AE>"
    bos: str = "<s>"
    eos: str = "</s>"
    pad: str = "<pad>"
    newline: str = "\n"
    retrieval: str | None = None

    def __post_init__(self) -> None:
        own = [self.mem, self.ae, self.bos, self.eos, self.pad]
        if len(set(own)) < len(own) or not all(own):
            raise ValueError("special tokens must be distinct and not empty")

    @property
    def unscored(self) -> list[str]:
        """Tokens that never carry loss."""
        return [self.ae, self.pad, self.bos, self.mem]


@dataclass(frozen=True, kw_only=True)
class Lengths:
    """Lengths in tokens, the compression rate and the seed of all draws."""

    rate: int = 16
    compressor_max: int = 512
    decoder_max: int = 1024
    seed: int = 42

    def __post_init__(self) -> None:
        if min(self.rate, self.compressor_max, self.decoder_max) < 1:
            raise ValueError("lengths and rate must be positive")


@dataclass(frozen=True, kw_only=True)
class Pretraining:
    lengths: Lengths = field(default_factory=lambda: Lengths(compressor_max=128, decoder_max=512))
    specials: Specials = field(default_factory=Specials)
    ae_ratio: float = 0.5
    min_ratio: float = 0.8
    short: int = 64
    #: Whether text before the last placeholder is left out of the loss (the intent) or kept (as observed).
    mask_prefix: bool = False

    def __post_init__(self) -> None:
        if not 0 <= self.ae_ratio <= 1 or not 0 < self.min_ratio <= 1:
            raise ValueError("ae_ratio must lie in [0, 1], min_ratio in (0, 1]")


@dataclass(frozen=True, kw_only=True)
class Trajectory:
    lengths: Lengths = field(default_factory=lambda: Lengths(compressor_max=128, decoder_max=512))
    specials: Specials = field(default_factory=Specials)
    p_compress: float = 0.5
    #: Clamp the room of a step at 0 instead of reproducing the overshoot at an exactly full budget.
    strict_budget: bool = False


@dataclass(frozen=True, kw_only=True)
class Rag:
    lengths: Lengths = field(default_factory=lambda: Lengths(compressor_max=128, decoder_max=512))
    specials: Specials = field(default_factory=Specials)
    query_dependent: bool = False
    chunk_docs: bool = False
    chunk_overlap: int = 0
    n_max_chunks: int | None = None
    topk_docs: int | None = 5
    margin: int = 4
    system_prompt: str = "Use the documents to answer the question in a few words."
    user_prompt: str = "Documents: [documents] \n Question: [question]"

    def __post_init__(self) -> None:
        if self.chunk_docs and self.query_dependent:
            raise ValueError("chunk_docs and query_dependent exclude each other")
        if not 0 <= self.chunk_overlap < self.lengths.compressor_max:
            raise ValueError("chunk_overlap must be smaller than compressor_max")
        if "[documents]" not in self.user_prompt or "[question]" not in self.user_prompt:
            raise ValueError("user_prompt needs [documents] and [question]")

    def may_overflow(self) -> bool:
        """Whether chunked documents can exceed a tenth of the decoder's length."""
        return self.chunk_docs and (self.n_max_chunks is None or (self.lengths.compressor_max + 1) * self.n_max_chunks > 0.1 * self.lengths.decoder_max)


def dump(config: object) -> str:
    """A configuration as JSON text, for the file beside an output."""
    return json.dumps(asdict(config), indent=2, sort_keys=True)
