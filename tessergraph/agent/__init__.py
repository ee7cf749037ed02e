"""Questions in plain language: routing, tools, verified answers."""
