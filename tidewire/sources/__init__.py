"""From landed documents to item, issue and source-failure rows."""
