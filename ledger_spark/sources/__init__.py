"""Tables in and out: pages, model replies, transaction tables, report sets."""
