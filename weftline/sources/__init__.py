"""Sources and sinks: study files, vocabularies, catalogs; keyed and scoped writes."""
