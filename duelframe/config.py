"""Run configuration records, echoed into outputs where they change results."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class PrefConfig:
    """Parameters of a preference run (the full run's explicit values are the defaults).

    Texts are whole by default: ``max_length`` and ``max_prompt_length`` are caps only
    where a caller sets them (see ``TRAINER_CAPS``)."""

    beta: float = 0.1
    label_smoothing: float = 0.0
    reference_free: bool = False
    max_length: int | None = None
    max_prompt_length: int | None = None
    # Which end of the prompt survives truncation ('end' keeps the last tokens).
    prompt_keep: str = "end"
    # Which end of the answer survives sequence truncation ('start' keeps the first tokens).
    answer_keep: str = "start"
    batch_size: int = 1
    grad_accum: int = 8
    epochs: int = 1
    max_steps: int | None = None
    learning_rate: float = 1e-6
    warmup_ratio: float = 0.03
    logging_steps: int = 10
    save_steps: int = 1000
    bucket_edges: str = "0,32,64,96,128,99999"


# The caps of the training run, for audits that read what the trainer read.
TRAINER_CAPS = PrefConfig(max_length=512, max_prompt_length=128)


@dataclass(frozen=True)
class ChatTemplate:
    """Marker strings of a chat template; rendering is a pure column expression.

    A message renders as ``open + role + role_sep + content + close``; the generation
    marker is ``open + 'assistant' + role_sep``.  ``default_system`` is prepended when
    the chat does not start with a system message and it is not None.
    """

    open: str = "<|im_start|>"
    role_sep: str = "\n"
    close: str = "<|im_end|>\n"
    default_system: str | None = None
    special_tokens: tuple[str, ...] = field(default=("<|im_start|>", "<|im_end|>", "<|endoftext|>"))
