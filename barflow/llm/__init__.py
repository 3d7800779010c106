"""Training-data operators over the text records of the engine (news, posts, feed entries)."""
