"""Windows over a stream of frames: an extension, as the batch pipeline has no streaming counterpart."""
