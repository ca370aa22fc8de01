"""Tables that the library reads and writes."""
