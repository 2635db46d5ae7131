"""From rule and template texts to Columns."""
