"""Job parameters. Plain values that travel with a run, not a table."""

from __future__ import annotations

from dataclasses import dataclass

# Folder names, limits and label used by every run unless overridden.
INBOX_FOLDER = "00 Inbox"
NOTES_FOLDER = "01 Notes"
ASSETS_FOLDER = "04 Assets"
NEWSLETTER_LABEL = "Newsletters"
LOOKBACK_DAYS = 7
RESULT_TTL_DAYS = 29
PROMPT_MAX_CHARS = 6000
FILENAME_MAX_CHARS = 200
MIN_PLAUSIBLE_YEAR = 2005


@dataclass(frozen=True)
class JobSettings:
    inbox_folder: str = INBOX_FOLDER
    notes_folder: str = NOTES_FOLDER
    assets_folder: str = ASSETS_FOLDER
    newsletter_label: str = NEWSLETTER_LABEL
    lookback_days: int = LOOKBACK_DAYS
    result_ttl_days: int = RESULT_TTL_DAYS
    # Longest content a scorer is asked about; None asks about whole texts.
    prompt_max_chars: int | None = PROMPT_MAX_CHARS
    enrich_from_web: bool = True
    # None reads every new message; 50 gives the page limit of the mail search.
    max_per_source: int | None = None
    # Scorer calls that a task has under way at once, and how many may begin in a second.
    in_flight: int = 1
    per_second: float | None = None
