"""Part of legispark; see the README for the layout."""
