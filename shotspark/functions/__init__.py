"""Pure column expressions: vocabularies, shot filters, feature generators."""
