"""Types a graph may hold: presets, registry with guardrails, and their text form."""
