"""Settings shared by the plans. All of them are plain values, so they ship with closures."""

from __future__ import annotations

from dataclasses import dataclass

SPLITS = ("train", "val", "test", "predict")
FORMATS = ("parquet", "json", "jsonl", "csv", "tsv")


def check_split(split: str) -> str:
    if split not in SPLITS:
        raise ValueError(f"invalid split: {split!r}, expected one of {SPLITS}")
    return split


def check_format(fmt: str) -> str:
    if fmt not in FORMATS:
        raise ValueError(f"unsupported dataset format: {fmt!r}, expected one of {FORMATS}")
    return fmt


@dataclass(frozen=True)
class ColumnNames:
    """Names of the columns (and turn fields) a table uses."""

    instruction: str = "instruction"
    data: str = "input"
    target: str = "response"
    chosen: str = "chosen"
    rejected: str = "rejected"
    messages: str = "messages"
    role: str = "role"
    content: str = "content"


@dataclass(frozen=True)
class ChatMarkers:
    """Pieces of the prompt template; the defaults give the ChatML form.

    ``generation_suffix`` follows the opening of the assistant turn in predict mode,
    for templates that add a thinking block there.
    """

    turn_start: str = "<|im_start|>"
    turn_end: str = "<|im_end|>"
    role_separator: str = "\n"
    turn_separator: str = "\n"
    system: str = "system"
    user: str = "user"
    assistant: str = "assistant"
    generation_suffix: str = ""

    @property
    def response_start(self) -> str:
        return self.turn_start + self.assistant


@dataclass(frozen=True)
class ChatTemplate:
    """A prompt form with text of its own around the turns of each role.

    ``turns`` holds ``(role, before, after)``; a turn of another role is an error. With
    ``thought``, the marks around a thought, assistant turns before the last user turn lose
    all up to their last closing mark, and the line breaks after it. ``opening`` begins the
    turn to generate, followed by ``no_thought`` where thinking is off. ``default_system`` is
    the system turn of conversations that begin with another role; None adds none.
    """

    turns: tuple[tuple[str, str, str], ...]
    opening: str
    thought: tuple[str, str] | None = None
    no_thought: str = ""
    default_system: str | None = None
    system: str = "system"
    user: str = "user"
    assistant: str = "assistant"


@dataclass(frozen=True)
class TokenSpec:
    """Lengths and padding of encoded rows, and the tokens with a fixed id.

    ``special`` and then ``roles`` take the ids 0, 1, 2, ... of a vocabulary counted from
    a corpus; only ``special`` is left out of decoded text. A ``pad_token`` of None means
    that the end-of-turn token pads.
    """

    data_max_length: int = 2048
    target_max_length: int = 2048
    left_padding: bool = False
    pad_token: str | None = "<|pad|>"
    unk_token: str = "<|unk|>"
    eos_token: str = "<|im_end|>"
    special: tuple[str, ...] = ("<|pad|>", "<|unk|>", "<|im_start|>", "<|im_end|>")
    roles: tuple[str, ...] = ("system", "user", "assistant")
    ignore_index: int = -100

    @property
    def reserved(self) -> tuple[str, ...]:
        return self.special + self.roles

    @property
    def pad(self) -> str:
        return self.eos_token if self.pad_token is None else self.pad_token

    def max_length(self, split: str) -> int:
        if split == "predict":
            return self.data_max_length
        return self.data_max_length + self.target_max_length


@dataclass(frozen=True)
class SplitSpec:
    """Validation share and seed. ``strict`` keeps validation rows out of train."""

    ratio: float = 0.01
    seed: int = 2025
    strict: bool = True


@dataclass(frozen=True)
class BatchSpec:
    devices: int = 8
    batch_size: int = 16


@dataclass(frozen=True)
class Recipe:
    """What one mode does with a table.

    ``is_sft`` masks the labels outside assistant turns; without it every id is a label.
    Predict rows get labels only on request (``label_predict``). A ``template`` renders
    prompts in place of the markers, which still say where assistant turns begin for the
    labels; ``thinking`` leaves the thought to the model in predict mode.
    """

    split: str = "train"
    splits: SplitSpec = SplitSpec()
    tokens: TokenSpec = TokenSpec()
    batches: BatchSpec = BatchSpec()
    markers: ChatMarkers = ChatMarkers()
    names: ColumnNames = ColumnNames()
    is_sft: bool = True
    label_predict: bool = False
    template: ChatTemplate | None = None
    thinking: bool = False

    def __post_init__(self) -> None:
        check_split(self.split)

    @property
    def predicting(self) -> bool:
        return self.split == "predict"

    @property
    def max_length(self) -> int:
        return self.tokens.max_length(self.split)
