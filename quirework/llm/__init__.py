"""Training-data operators: archive, packing, licences, decontamination, dedup, quality, chat, reputation."""
