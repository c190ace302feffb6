"""Training-data operators on the texts and vectors that belong to photos; nothing else in the library imports them."""
